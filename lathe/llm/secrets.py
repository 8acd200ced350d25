"""Secrets in texts: pattern candidates, and a random forest that removes false positives.

DataFrame and SQL functions throughout. A pattern finds candidates in whole
texts (tokens of 16 characters or more with letters and digits, values assigned
to a secret's name, private key blocks). Features are the candidate's length,
its transitions between classes of characters, how much of it dictionary words
cover, whether it is part of a path or address, and the words around it. The
forest is trained on labelled findings: a table of the caller's, or findings
made by rule (labelled_findings(), a bounded number).

Null and empty texts have no candidates. Rows with equal ids are searched each, and
very long texts whole. Equal candidates in equal surroundings have equal
probabilities; one that ties with THRESHOLD is a secret. Positions are code points,
from 0, ends exclusive. Empty table: no rows. Extra columns are kept by masked(),
whatever their names, and not read otherwise. Without labelled findings
of both kinds, every candidate counts as a secret.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .staging import written

_CHAR = "[A-Za-z0-9+/_-]"
_NAME = "(?i:passw(?:or)?d|passwd|pwd|secret|token|api_?key|access_?key|auth)"
PATTERN = (
    r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s]*+(?:-----END [A-Z ]{0,20}PRIVATE KEY-----)?"
    rf"|(?<!{_CHAR})(?={_CHAR}{{16}})(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z]){_CHAR}++={{0,2}}+"
    rf"|(?<=[=:\"'] {{0,1}})(?<={_NAME}[\"']{{0,1}} {{0,2}}[:=] {{0,2}}[\"']{{0,1}})[^\s\"']{{8,}}+"
)
AROUND, FINDINGS, TREES, DEPTH, THRESHOLD = 48, 6000, 24, 7, 0.5
BROADCAST_ROWS = 1_000_000
#: The dictionary; dictionary= takes another.
WORDS = "the and for that with this from have not are was you key name test data file user code main class value index config system string return public static example default version number service client server request response content image path type list map item page link node text time date order account module function".split()
FEATURES = ["length", "transitions", "digits", "upper", "distinct", "hexadecimal", "separators", "covered", "in_path", "quoted", "assigned", "named", "counter", "placeholder", "prefix", "key_block", "repeats"]


def candidates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, start, end, value, before, after of each candidate."""
    hit = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").rlike(PATTERN))
    hit = hit.withColumn("text_key", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    values, between = F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)), F.split("text", PATTERN, -1)
    parts = F.arrays_zip(values.alias("value"), F.transform(between, lambda p: F.length(p)).alias("gap"), F.transform(between, lambda p: F.right(p, F.lit(AROUND))).alias("before"), F.slice(F.transform(between, lambda p: F.left(p, F.lit(AROUND))), 2, F.greatest(F.size(values), F.lit(1))).alias("after"))
    each = hit.select("doc_id", "text_key", "row", F.posexplode(parts).alias("at", "p")).select("doc_id", "text_key", "row", "at", "p.*").where("value IS NOT NULL")
    upto = F.sum(F.col("gap") + F.length("value")).over(Window.partitionBy("row").orderBy("at"))
    each = each.withColumn("end", upto.cast("long")).withColumn("start", F.col("end") - F.length("value"))
    return each.select("doc_id", "text_key", "start", "end", "value", "before", "after")


def with_features(found: DataFrame, dictionary: Sequence[str] = tuple(WORDS)) -> DataFrame:
    """Adds FEATURES to value, before, after."""
    v, before, after = F.col("value"), F.col("before"), F.col("after")
    n = F.length(v)
    share = lambda pattern: F.regexp_count(v, F.lit(pattern)) / n
    has = lambda c, pattern: F.coalesce(c.rlike(pattern), F.lit(False)).cast("double")
    near = F.concat(before, F.lit(" "), after)
    covered = 1 - F.length(F.regexp_replace(F.lower(v), "|".join(dictionary), "")) / n
    made: dict[str, Column] = {
        "length": F.log2(n.cast("double")),
        "transitions": F.regexp_count(v, F.lit("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])")) / n,
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        # The mean over the value's consecutive runs of 256 characters: a whole value's share falls with its length.
        "distinct": F.aggregate(F.regexp_extract_all(v, F.lit("(?s).{1,256}"), F.lit(0)), F.lit(0), lambda sum, run: sum + F.size(F.array_distinct(F.split(run, "")))) / n,
        "hexadecimal": has(v, "^(?:[0-9a-f]+|[0-9A-F]+)$"),
        "separators": share("[-_/+=]"),
        "covered": covered,
        "in_path": has(before, r"(?:[/\\]|://\S*|\S\.)$") + has(v, "^/|/[a-z]+/"),
        "quoted": has(before, "[\"'`]$"),
        "assigned": has(before, r"[=:]\s*[\"'`]?$"),
        "named": has(before, rf"{_NAME}\W{{0,8}}$") + has(before, "(?i)bearer |authorization|credential|private"),
        "counter": has(near, r"(?i)commit|checksum|sha-?\d|md5|digest|uuid|guid|isbn|revision|etag|integrity|hash\b"),
        "placeholder": has(F.concat(before, v), "(?i)example|sample|dummy|placeholder|your[-_]|xxxx|changeme|1234567890|abcdef012"),
        "prefix": has(v, "^(?:AKIA|ASIA|ghp_|gho_|github_pat_|sk_live_|sk-|xox[abp]-|AIza|eyJ|glpat-|npm_)"),
        "key_block": has(v, "^-----BEGIN"),
        "repeats": has(v, r"(.)\1{4}"),
    }
    return found.withColumns({name: F.coalesce(made[name].cast("double"), F.lit(0.0)) for name in FEATURES})


def labelled_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """n findings made by rule, half of them secrets: value, before, after, label. The values are hashes of row numbers."""
    i = F.col("id")
    h = lambda salt: F.sha2(F.concat(i.cast("string"), F.lit(salt)), 256)
    b64 = lambda salt, k: F.substring(F.translate(F.base64(F.unhex(F.concat(h(salt), h(salt + "+")))), "=\r\n", ""), 1, k)
    mixed = lambda salt, k: F.substring(F.translate(b64(salt, 80), "+/", "aZ"), 1, k)
    pick = lambda salt, options: F.element_at(F.array(*map(F.lit, options)), (F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(len(options))) + 1).cast("int"))
    hexes = F.expr("substring(sha2(concat(id, 'x'), 256), 1, element_at(array(32, 40, 48, 64), CAST(pmod(id, 4) + 1 AS INT)))")
    words = F.concat_ws("_", pick("a", WORDS), pick("b", WORDS), pick("c", WORDS), F.pmod(i, F.lit(97)).cast("string"))
    names, joins, quotes = ["token", "api_key", "secret", "password", "access_key", "auth_token", "client_secret", "apikey"], [" = ", "=", ": ", " := "], ['"', "'", ""]
    quote = pick("q", quotes)
    assigned = F.concat(pick("w", ["", "the ", "set ", "const ", "export ", "über la "]), pick("n", names), pick("j", joins), quote)
    plain = F.concat(pick("w", ["see ", "in ", "the ", "of ", "- ", "und "]))
    cases: list[tuple[Column, Column, Column, int]] = [
        (hexes, assigned, quote, 1), (b64("s", 40), assigned, quote, 1), (mixed("m", 24), assigned, quote, 1),
        (F.concat(F.lit("AKIA"), F.upper(mixed("k", 16))), F.concat(plain, quote), quote, 1), (F.concat(F.lit("ghp_"), mixed("g", 36)), F.concat(plain, quote), quote, 1),
        (F.concat(F.lit("sk_live_"), mixed("l", 24)), assigned, quote, 1), (F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), b64("p", 80)), F.lit("\n"), F.lit("\n"), 1),
        (mixed("w", 12), F.concat(pick("u", ["password", "passwd", "pwd", "secret"]), pick("j", joins), quote), quote, 1), (hexes, F.concat(plain, F.lit("Authorization: Bearer ")), F.lit("\n"), 1), (mixed("y", 43), F.concat(assigned), quote, 1),
        (F.substring(h("c"), 1, 40), F.concat(plain, pick("d", ["commit ", "revision ", "checkout commit ", "git show "])), F.lit(" "), 0), (hexes, F.concat(plain, pick("d", ["md5: ", "sha256: ", "checksum = ", "SHA-1 digest: ", "etag: "])), F.lit("\n"), 0),
        (words, F.concat(plain, quote), quote, 0), (F.concat(words, F.lit("_"), pick("z", WORDS)), F.concat(pick("w", ["return ", "self.", "import ", "def "])), F.lit("("), 0),
        (F.concat_ws("/", pick("a", WORDS), pick("b", WORDS), F.substring(h("f"), 1, 8), pick("c", WORDS)), pick("o", ["https://www.", "see /", "../", "http://cdn.net/"]), F.lit(".png"), 0),
        (F.concat_ws("-", F.substring(h("u"), 1, 8), F.substring(h("u"), 9, 4), F.substring(h("u"), 13, 4), F.substring(h("u"), 17, 4), F.substring(h("u"), 21, 12)), F.concat(plain, pick("d", ["uuid ", "id=", "guid: ", "request "])), F.lit(" "), 0),
        (pick("e", ["your_api_key_here_1234", "xxxxxxxxxxxxxxxx1234", "EXAMPLEKEY1234567890", "changeme12345678", "0000000000000000000a", "sample_token_abcdef0123456789"]), assigned, quote, 0),
        (F.concat_ws("-", pick("a", WORDS), pick("b", WORDS), pick("c", WORDS), F.lit("2024"), F.lit("01")), F.concat(plain), F.lit(" "), 0), (F.concat(F.lit("0x"), F.substring(h("h"), 1, 40)), F.concat(plain, F.lit("hash ")), F.lit("."), 0), (b64("i", 60), F.lit("src=data:image/png;base64,"), F.lit('"'), 0),
    ]
    kind = F.pmod(i, F.lit(len(cases)))
    choose = lambda k: F.coalesce(*(F.when(kind == j, c[k] if isinstance(c[k], Column) else F.lit(c[k])) for j, c in enumerate(cases)))
    made = spark.range(n).select(choose(0).alias("value"), F.right(choose(1), F.lit(AROUND)).alias("before"), choose(2).alias("after"), choose(3).alias("label"))
    return made.where(F.length("value") >= 8)


def scored(found: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """Adds probability and is_secret to candidates."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    findings = labelled_findings(found.sparkSession) if findings is None else findings
    assemble = VectorAssembler(inputCols=FEATURES, outputCol="features")
    rows = assemble.transform(with_features(findings)).select("features", F.col("label").cast("double").alias("label")).coalesce(1)
    if rows.select("label").distinct().count() < 2:
        return found.withColumn("probability", F.lit(1.0)).withColumn("is_secret", F.lit(True))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=7, featureSubsetStrategy="sqrt").fit(rows)
    names = found.columns
    p = vector_to_array("probability")[1]
    out = forest.transform(assemble.transform(with_features(found))).withColumn("p", p)
    return out.select(*names, F.col("p").alias("probability"), (F.col("p") >= THRESHOLD).alias("is_secret"))


def findings(docs: DataFrame, labelled: DataFrame | None = None, **kw) -> DataFrame:
    """doc_id, start, end, value_sha256, probability, is_secret: all candidates, with the forest's decision."""
    out = scored(candidates(docs, **kw), labelled)
    return out.select("doc_id", "start", "end", F.sha2("value", 256).alias("value_sha256"), "probability", "is_secret")


def masked(docs: DataFrame, labelled: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """docs with each secret of the text, wherever it stands there, replaced by mask."""
    found = scored(candidates(docs, id_col=id_col, text_col=text_col), labelled)
    values = found.groupBy("doc_id", "text_key", "value").agg(F.bool_or("is_secret").alias("secret"), F.collect_set(F.struct("start", "end")).alias("s")).where("secret")
    spans = written(values.groupBy("doc_id", "text_key").agg(F.array_sort(F.flatten(F.collect_list("s"))).alias("spans")), "secrets")
    spans = F.broadcast(spans) if spans.agg(F.coalesce(F.sum(F.size("spans") + 2), F.lit(0))).first()[0] <= BROADCAST_ROWS else spans
    spans = spans.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("spans").alias("__spans"))
    text = F.col(text_col)
    both = docs.join(spans, docs[id_col].cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__key")), "left")
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).cast("long").alias("at"))
    cut = lambda a, b: F.substring(text, a.cast("int") + 1, b.cast("int"))
    step = lambda acc, s: F.struct(F.array_append(F.array_append(acc["parts"], cut(acc["at"], s["start"] - acc["at"])), F.lit(mask)).alias("parts"), s["end"].alias("at"))
    done = F.aggregate("__spans", start, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), cut(acc["at"], F.length(text))))
    return both.withColumn(text_col, F.when(F.col("__spans").isNull(), text).otherwise(done)).select(docs.columns)
