"""Secret scans: a random forest that removes false positives, in DataFrame functions only.

Candidates are long runs of key characters with a digit among them, blocks of
private keys, JSON web tokens, passwords in addresses, and what is assigned to a
telling name such as password, however short. Each is described by its length, the changes of character class in it, how much of it
common words cover, whether it is a path, and the words beside it; a forest
trained on labelled findings then tells secrets from identifiers, checksums,
paths, numbers and placeholders. Candidate search, features and scoring run
inside the JVM.

Defined results: a null or empty text has no findings, and neither has one
without a candidate; a run of any length is one candidate; a score equal to the
threshold (a tie) is a secret; rows repeated in full
give their findings once each; an empty table gives an empty result; other
columns of the input are ignored. Labelled findings of one kind only give every
candidate that kind's score.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import as_row, materialise

#: What a candidate is; the first that fits is taken. A run's equals sign belongs to it only as padding at its end.
BLOCK = r"-----BEGIN [A-Z0-9 ]{0,24}PRIVATE KEY-----[A-Za-z0-9+/=\s]*+(?:-----END [A-Z0-9 ]{0,24}PRIVATE KEY-----)?"
JSON_TOKEN = r"(?<![A-Za-z0-9_+/-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+(?:\.[A-Za-z0-9_-]*+)?"
#: The password of an address, user:password@host.
IN_ADDRESS = r"(?<=:)(?=[^\s/:@]{4,200}@[A-Za-z0-9])(?<=://[^\s/:@]{1,64}:)[^\s/:@]{4,200}(?=@)"
RUN = r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*[0-9])(?:[A-Za-z0-9_+/-]{16,}+(?:={1,2}(?![A-Za-z0-9_+/=-]))?|[A-Za-z0-9_+/-]{15}={1,2}(?![A-Za-z0-9_+/=-])|[A-Za-z0-9_+/-]{14}==(?![A-Za-z0-9_+/=-]))"
#: A value of any six characters or more that is assigned to a telling name: passwords are short, and many have no digit.
TELLING = r"(?i:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|(?:api|access|auth|private|signing|encryption)[_ -]?key)"
ASSIGNED = r"(?<=[:=]\s{0,3}[\"'`]?)(?<![A-Za-z0-9_+/-])(?<=" + TELLING + r"[\"'\])]{0,2}\s{0,3}(?::=|[:=]|=>)\s{0,3}[\"'`]?)[^\s\"'`,;<>(){}\[\]:=]{6,200}"
CANDIDATE = "|".join((BLOCK, JSON_TOKEN, IN_ADDRESS, RUN, ASSIGNED))
BEFORE, AFTER = 48, 24
THRESHOLD = 0.5
TREES, DEPTH, SEED = 30, 7, 7
TRAIN_FINDINGS = 6000

#: Words whose letters in a candidate speak against a secret.
WORDS = (
    "access", "account", "action", "address", "admin", "alpha", "api", "app", "archive", "array", "asset", "auto", "base", "batch", "beta", "bin", "block", "build", "button", "byte",
    "cache", "change", "char", "check", "class", "click", "client", "cloud", "code", "color", "column", "com", "config", "content", "control", "core", "count", "create", "data", "date",
    "default", "dev", "dist", "doc", "document", "edit", "element", "entry", "error", "event", "example", "export", "field", "file", "filter", "font", "form", "format", "frame", "from",
    "function", "get", "group", "handler", "hash", "header", "here", "home", "host", "html", "http", "icon", "image", "import", "index", "info", "input", "item", "java", "key",
    "label", "lib", "line", "link", "list", "local", "log", "main", "map", "master", "max", "menu", "message", "method", "min", "mode", "model", "module", "name", "node",
    "number", "object", "option", "order", "output", "package", "page", "param", "parent", "part", "path", "placeholder", "plugin", "post", "project", "python", "query", "queue", "release", "report",
    "request", "response", "result", "sample", "schema", "script", "section", "server", "service", "session", "set", "setting", "share", "size", "source", "start", "state", "static", "status", "string",
    "style", "system", "table", "target", "task", "template", "test", "text", "the", "theme", "time", "title", "type", "update", "url", "user", "usr", "util", "value", "version",
    "view", "web", "widget", "window", "with", "word", "work", "your", "zone",
)
#: Words beside a candidate that speak for a secret, and against one.
FOR = "secret|token|passw|passphrase|pwd|api[ _-]?key|apikey|access[ _-]?key|private[ _-]?key|auth|bearer|credential|signature"
AGAINST = "commit|sha1|sha256|sha512|md5|checksum|digest|integrity|hash|uuid|guid|revision|etag|path|file|see|order|invoice|phone|isbn|card|serial"
FEATURES = ["length", "transitions", "transition_rate", "digit_share", "upper_share", "other_share", "distinct_share", "longest_letters", "dictionary", "slashes", "is_path", "only_hex", "says_secret", "says_other", "near_other", "assigned", "quoted", "placeholder", "block", "in_address", "word_like", "short"]


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start (characters before it), candidate, before, after."""
    text = F.col("text")
    source = docs.select(F.monotonically_increasing_id().alias("row_key"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    cut = source.filter(text.rlike(CANDIDATE)).select("row_key", "doc_id", F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("found"), F.split(text, CANDIDATE, -1).alias("gaps"))
    n = F.size("found")
    # A gap can be a lone equals sign, after a name that is a run itself; what is before a run then holds that name.
    zipped = F.arrays_zip("found", F.slice("gaps", 1, n).alias("gap"), F.slice("gaps", 2, n).alias("next"), F.slice(F.concat(F.array(F.lit("")), "found"), 1, n).alias("last"))
    rows = cut.select("row_key", "doc_id", F.posexplode(zipped)).select("row_key", "doc_id", "pos", F.col("col.found").alias("candidate"), F.col("col.gap").alias("gap"), F.col("col.next").alias("next"), F.col("col.last").alias("last"))
    slim = rows.select("row_key", "doc_id", "pos", "candidate", F.length("gap").alias("gap_length"), F.right(F.concat("last", "gap"), F.lit(BEFORE)).alias("before"), F.left("next", F.lit(AFTER)).alias("after"))
    upto = W.partitionBy("row_key").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    start = F.sum(F.col("gap_length") + F.length("candidate")).over(upto) - F.length("candidate")
    return slim.select("doc_id", start.cast("long").alias("start"), "candidate", "before", "after")


def featured(found: DataFrame) -> DataFrame:
    """The rows with one column for each of FEATURES; needs candidate, before, after."""
    c, before, after = F.col("candidate"), F.lower("before"), F.lower("after")
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    size = F.length(c).cast("double")
    change = "(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])"
    flag = lambda test: test.cast("double")
    covered = size - F.length(F.regexp_replace(F.lower(c), "|".join(sorted(WORDS, key=len, reverse=True)), ""))
    runs = F.transform(F.regexp_extract_all(c, F.lit("[A-Za-z]+"), F.lit(0)), lambda r: F.length(r))
    values: dict[str, Column] = {
        "length": size, "transitions": count(c, change), "transition_rate": count(c, change) / size,
        "digit_share": count(c, "[0-9]") / size, "upper_share": count(c, "[A-Z]") / size, "other_share": count(c, "[^A-Za-z0-9]") / size,
        "distinct_share": F.size(F.array_distinct(F.split(c, ""))) / F.least(size, F.lit(64.0)),
        "longest_letters": F.coalesce(F.array_max(runs), F.lit(0)).cast("double"), "dictionary": covered / size,
        "slashes": count(c, "/"), "is_path": flag(c.rlike("^[./~]?/?[A-Za-z0-9_.-]+(/[A-Za-z0-9_.=-]+){2,}$") | after.rlike(r"^\.[a-z]{1,5}\b")),
        "only_hex": flag(c.rlike("^(0x)?[0-9a-f]+$|^[0-9A-F]+$")),
        "says_secret": flag(before.rlike(f"({FOR})[^a-z]{{0,8}}$")), "says_other": flag(before.rlike(f"({AGAINST})[^a-z]{{0,8}}$")),
        "near_other": flag(before.rlike(AGAINST) | after.rlike(AGAINST)), "assigned": flag(before.rlike(r"[:=]\s*[\"']?$")),
        "quoted": flag(before.rlike("[\"'`]$") & after.rlike("^[\"'`]")),
        "block": flag(c.startswith("-----BEGIN")), "in_address": flag(before.rlike("://[^\\s/:@]{1,64}:$")),
        "word_like": flag(c.rlike("^[A-Za-z]?[a-z]+[.!?]?$|^[A-Z]+$|^[a-z]+([_.-][a-z]+)+$|^[a-z]+([A-Z][a-z]+)+$")), "short": flag(size < 16),
        "placeholder": flag(c.rlike(r"(?i)(.)\1{5,}|^(my|insert)[_-]|example|sample|your|placeholder|change_?me|dummy|1234567|^[*x.#-]+$|\\$|%s|^(null|none|true|false|undefined|required|optional|string|secret|password|env)")),
    }
    return found.select("*", *[F.coalesce(values[k], F.lit(0.0)).alias(k) for k in FEATURES])


def synthetic_findings(spark: SparkSession, n: int = TRAIN_FINDINGS) -> DataFrame:
    """Labelled findings by rule: before, candidate, after, is_secret. Twelve kinds of secrets, eighteen of others.

    They are what `candidates` finds in n texts made by these rules, so that a form is learned as documents show it.
    """
    i = F.col("id")
    hexed = lambda salt, size: F.substring(F.sha2(F.concat(F.lit(salt), i.cast("string")).cast("binary"), 256), 1, size)
    sixty = F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat(F.lit("b"), i.cast("string")).cast("binary"), 256))), "[+/=]", "7")
    word = lambda k: F.element_at(F.array(*map(F.lit, WORDS)), (F.pmod(F.xxhash64(i, F.lit(k)), F.lit(len(WORDS))) + 1).cast("int"))
    prose = F.concat_ws(" ", word(11), word(12), word(13))
    say = lambda *s, salt=21: F.element_at(F.array(*map(F.lit, s)), (F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(len(s))) + 1).cast("int"))
    digits = F.translate(hexed("d", 24), "abcdef", "012345")
    letters = F.translate(hexed("l", 40), "0123456789abcdef", "kTzqWvnRbxmPgsYd")
    tell = say(" password=", " password: ", ' "password": "', " passwd=", ' db_password = "', " DB_PASS=", " secret: ", ' passphrase: "', " pwd=", " token=", " login password: ")
    kinds = [  # before, candidate, after, is_secret
        (F.concat(prose, say(' token = "', " token: '", ' access_token="', " auth_token = '")), hexed("a", 40), F.lit('" and'), 1),
        (F.concat(prose, say(' api_key = "', " api-key: ", " apikey=", ' x-api-key: "')), F.substring(sixty, 1, 32), F.lit('"'), 1),
        (F.concat(prose, say(" password=", ' passwd: "', " pwd = '", ' passphrase="')), F.substring(sixty, 3, 20), F.lit("'"), 1),
        (F.concat(prose, say(" aws_access_key_id = ", ' access key: "', " credential ")), F.concat(F.lit("AKIA"), F.upper(hexed("k", 16))), F.lit(" "), 1),
        (F.concat(prose, say(" authorization: bearer ", " bearer ")), F.concat(sixty, F.lit("A9"), hexed("j", 20)), F.lit(" in"), 1),
        (F.concat(prose, say(" secret_key=", ' secret = "', " client_secret: ")), hexed("s", 32), F.lit(""), 1),
        (F.concat(prose, say(" ", " the ", " card ", " order ", ": ")), F.substring(digits, 1, 16), F.lit(" "), 0),
        (F.concat(prose, say(" see ", " path ", " in ", " = ")), F.concat(F.lit("/"), word(1), F.lit("/"), word(2), F.lit("/"), word(3), F.lit("3/"), word(4)), F.lit(".py"), 0),
        (F.concat(prose, say(" commit ", " sha256:", " checksum = ", " integrity sha512-", " md5: ")), hexed("c", 40), F.lit(" "), 0),
        (F.concat(prose, say(" ", " = ", ": ", ' "')), F.concat(word(1), F.lit("_"), word(2), F.lit("_"), word(3), F.lit("_"), F.substring(digits, 1, 2)), F.lit(" "), 0),
        (F.concat(prose, say(' token = "', " password=", ' api_key: "')), say("xxxxxxxxxxxxxxxxxxxx1", "your_api_key_here_123", "0000000000000000000000", "example_token_12345678", "1234567890123456"), F.lit('"'), 0),
        (F.concat(prose, say(" request id ", " uuid ", " guid=", " id: ")), F.concat_ws("-", hexed("u", 8), hexed("v", 4), hexed("w", 4), hexed("x", 4), hexed("y", 12)), F.lit(" "), 0),
        (F.concat(prose, say(" ", " of ", " the ")), F.concat(word(5), word(6), word(7), F.substring(digits, 1, 3)), F.lit("."), 0),
        (F.concat(prose, say(" ", " phone ", " serial ", " at ")), F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 4), F.substring(digits, 9, 2), F.substring(digits, 11, 6)), F.lit(" "), 0),
        (F.concat(prose, say(" ", " export ", " set ", "; ")), F.concat_ws("_", F.upper(word(6)), F.substring(digits, 1, 1), say("PROD", "DB", "AWS", "MAIN"), say("SECRET", "TOKEN", "KEY", "PASSWORD")), F.lit('="'), 0),
    ]
    kinds += [
        (F.concat(prose, tell), F.concat(F.substring(letters, 1, 5), F.substring(digits, 1, 3)), F.lit(" "), 1),
        (F.concat(prose, tell), F.substring(letters, 3, 9), F.lit(" "), 1),
        (F.concat(prose, tell), F.concat(F.initcap(word(31)), say("!", "@", "#", "_", "$", ".", salt=23), F.substring(digits, 2, 4)), F.lit(" "), 1),
        (F.concat(prose, say(" ", ": ", "\n")), F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), sixty, F.lit("\n"), F.substring(sixty, 5, 30), F.lit("\n-----END RSA PRIVATE KEY-----")), F.lit("\n"), 1),
        (F.concat(prose, say(" bearer ", " token ", ' "jwt": "', " cookie=")), F.concat(F.lit("eyJ"), F.substring(sixty, 1, 20), F.lit(".eyJ"), F.substring(sixty, 8, 30), F.lit("."), hexed("w", 27)), F.lit(" "), 1),
        (F.concat(prose, say(" postgres://", " mysql://", " amqp://", " https://", " redis://"), word(33), F.lit(":")), F.concat(F.substring(letters, 2, 6), F.substring(digits, 3, 3)), F.concat(F.lit("@"), word(34), F.lit(".local/x")), 1),
        (F.concat(prose, tell), F.concat(word(35), say("_", ".", "", salt=22), word(36)), F.lit(" "), 0),
        (F.concat(prose, tell), say("required", "optional", "string", "undefined", "********", "changeme", "your_password", "password", "xxxxxxxx", "disabled", "<redacted>", "unknown", "expired", "invalid", salt=24), F.lit(" "), 0),
        (F.concat(prose, tell), F.concat(say("os.environ.", "config.", "process.env.", "settings.", "$", "self.", "request.", salt=25), F.upper(word(37)), say("_PASSWORD", "_TOKEN", "_KEY", "", salt=26)), F.lit(" "), 0),
        (F.concat(prose, say(" secret: ", " the token: ", " password: ")), F.concat(word(38), say("ing", "ed", "s", "er", "ment", salt=27)), F.lit(" and"), 0),
        (F.concat(prose, say(" https://", " http://"), word(39), F.lit(":")), F.lit("port"), F.concat(F.lit("@"), word(34)), 0),
        (F.concat(prose, say(" class ", " new ", " ", " import ", " the ")), F.concat(F.initcap(word(41)), F.initcap(word(42)), F.initcap(word(43)), F.substring(digits, 1, 1), F.initcap(word(44))), say("(", " ", "."), 0),
        (F.concat(prose, say(" ", " name=", " picture ", "/", '"')), F.concat(F.upper(F.left(word(45), F.lit(3))), F.lit("_"), F.substring(digits, 1, 8), F.lit("_"), F.substring(digits, 9, 6)), say(".jpg", " ", "_x"), 0),
        (F.concat(prose, say(" ", " part ", " serial ", " batch ", " no. ")), F.concat_ws("-", F.upper(F.substring(letters, 1, 2)), F.substring(digits, 1, 8), F.upper(hexed("q", 4)), F.substring(digits, 5, 4)), F.lit(" "), 0),
        (F.concat(prose, say(" api_key: ", " token=", " API_KEY=", " secret: ", ' password = "')), F.concat(say("YOUR_", "MY_", "INSERT_", "your-", "EXAMPLE_", salt=28), F.upper(word(46)), say("_HERE_", "_KEY_", "_", salt=29), F.substring(digits, 1, 4)), F.lit(" "), 0),
    ]
    pick, texts = F.pmod(i, F.lit(len(kinds))), None
    for first in range(0, len(kinds), 6):  # some kinds at a time, as the code of all is too long to compile
        row = None
        for k, (before, candidate, after, label) in enumerate(kinds[first : first + 6], first):
            made = F.struct(F.concat(before, candidate, after).alias("text"), F.lit(label).alias("is_secret"))
            row = F.when(pick == k, made) if row is None else row.when(pick == k, made)
        part = spark.range(n).filter(pick.between(first, first + 5)).select(row.alias("r")).select("r.is_secret", "r.text")
        texts = part if texts is None else texts.unionAll(part)
    # Written first, the rules are not compiled again into each use of a text.
    found = candidates(materialise(texts, "synthetic-texts"), "is_secret")
    return materialise(found.select("before", "candidate", "after", F.col("doc_id").alias("is_secret")), "synthetic-findings")


def train(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = SEED):
    """A forest over labelled findings (before, candidate, after, is_secret)."""
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(featured(findings)).select("features", F.col("is_secret").cast("double").alias("label"))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(rows)


def findings(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, start, length, candidate_sha256, score, is_secret; one row per candidate."""
    kinds = [r["is_secret"] for r in labelled.select(F.col("is_secret").cast("int").alias("is_secret")).distinct().limit(2).collect()]
    found = candidates(docs, id_col, text_col)
    if len(kinds) < 2:
        scored = found.withColumn("score", F.lit(float(kinds[0] if kinds else 0)))
    else:
        rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(featured(found))
        scored = train(labelled).transform(rows).withColumn("score", F.element_at(vector_to_array("probability"), 2))
    return scored.select("doc_id", "start", F.length("candidate").cast("long").alias("length"), F.sha2("candidate", 256).alias("candidate_sha256"), "score", (F.col("score") >= threshold).alias("is_secret"))


def redact(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "<secret>") -> DataFrame:
    """The documents with secrets replaced, other columns unchanged; found: findings() of the same documents. Rows that share an id, or have none, share their findings."""
    bad = found.filter("is_secret").groupBy(F.col("doc_id").alias("found_id")).agg(F.collect_set("candidate_sha256").alias("hashes"))
    text = F.col(f"row.`{text_col}`")
    joined = docs.select(as_row(docs)).join(bad, F.col(f"row.`{id_col}`").eqNullSafe(F.col("found_id")), "left")
    parts = F.transform(F.arrays_zip(F.split(text, CANDIDATE, -1).alias("gap"), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("run")), lambda p: F.concat(
        p["gap"], F.when(F.array_contains("hashes", F.sha2(p["run"], 256)), F.lit(mask)).otherwise(F.coalesce(p["run"], F.lit("")))))
    clean = F.when(F.col("hashes").isNull(), text).otherwise(F.array_join(parts, ""))
    return joined.select(*[(clean if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
