"""Op 3, secret scans: candidates, then a random forest that removes false positives. DataFrame functions only.

Candidates are searched inside words, between any delimiters, as many as a word has: runs of 12 or more key letters
with a digit, also with dots inside; values of "name=" or "name:" (in quotes or not, any symbols inside) of 12 or more
with a digit, and of any length and letters after a secret's name, also with spaces around the sign (a value ends at
the next space; what follows unquoted as punctuation isn't of it); bodies of private key blocks, without spaces.
The forest (trained in the JVM on labelled findings, 40 trees) looks at the candidate's length, its transitions
between lower case, upper case and digits, how much of it common letter groups of words cover, the text's path
(its source: tests and examples) and the two words before and the one after. Labelled findings are a table
(candidate, name, before, after, path, label); without one, ``labelled_findings`` makes a fixed number by rule.

One narrow pass over the texts; nothing is shuffled. Null and empty texts have no candidates. Repeated rows give
repeated findings. Other columns are ignored; the path column may be missing or null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values.
NAMES = "passw(or)?d|passwd|pwd|secret|token|api_?key|apikey|access_?key|auth|credential|private_?key"
HASHES = "sha1|sha256|md5|commit|revision|checksum|digest|uuid|etag|build|isbn|phone|order|invoice"
TESTS = "test|example|sample|fixture|mock|docs?/"
GROUPS = "the|ing|ion|and|ent|tion|for|her|ter|hat|ere|ate|his|con|res|ver|all|ons|nce|men|ith|ted|ers|pro|are|ess|not|ive|was|ect|rea|com|eve|per|int|est|sta|cti|ica|ist|ear|ain|one|our|iti|rat"
SPACE = "[\\x20\\x09-\\x0D]+"
#: A name, its sign and its value up to a delimiter and the quote after it; a bare run; a value whose name is in the words before.
ASSIGNED = "([A-Za-z_][A-Za-z0-9_.-]*)[\"'`]?\\]?(?::=|=>|==|=|:)(?!//)[\"'`]?([^\\s\"'`&,;()\\[\\]{}<>]+)([\"'`]?)"
BARE = "[A-Za-z0-9+/_=-]+(?:\\.[A-Za-z0-9+/_=-]+)*"
SPACED, QUOTED, PLAIN = f"(?i)({NAMES})[^\\s=:]*[\"'`]? ?(:=|=>|==|=|:)$", "^[(\\[{<]*([\"'`])(.+?)(?:\\1|$)", "^[(\\[{<]*([^\\s\"'`,;()\\[\\]{}<>]+)"
ENDING = "[.,:;!?#*%$&]+$"
FEATURES = ("n", "digits", "uppers", "transitions", "covered", "path_test", "named", "hashed", "prefix", "only_digits", "dashes")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """id, pos (word number), candidate, name, before, after, path."""
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col in docs.columns else F.lit("")
    words = docs.select(F.col(id_col), path.alias("path"), F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), SPACE).alias("words"))
    at = lambda i: F.coalesce(F.get("words", i), F.lit(""))
    # what may hold a candidate: a key's length and digit, a sign inside, or a sign or a key's mark before
    found = F.filter(F.transform("words", lambda w, i: F.when(
        ((F.length(w) >= 12) & w.rlike("[0-9]")) | w.rlike("[=:].") | at(i - 1).rlike("[=:>]$") | w.startswith("KEY-----"),
        F.struct(i.cast("long").alias("pos"), w.alias("word"), F.concat_ws(" ", at(i - 2), at(i - 1)).alias("before"), at(i + 1).alias("after"),
                 F.when(w.startswith("KEY-----") & (at(i - 1) == "PRIVATE"), body(F.slice("words", i + 2, F.size("words")))).alias("body")))),
        lambda x: x.isNotNull())
    rows = words.select(id_col, "path", F.inline(found))
    return rows.select(id_col, "pos", "before", "after", "path", F.inline(inside(F.col("word"), F.col("before"), F.col("body")))).select(
        id_col, "pos", "candidate", "name", "before", "after", "path",
    )


def body(rest):
    """Words up to the end mark of a key block, joined."""
    return F.regexp_extract(F.array_join(rest, ""), "^([^-]+)", 1)


def inside(word, before, block):
    """Structs (candidate, name) of a word, each once."""
    def one(candidate, name):
        return F.struct(candidate.alias("candidate"), name.alias("name"))

    def bare(value, closed):
        return F.when(closed != "", value).otherwise(F.regexp_replace(value, ENDING, ""))

    all_of = lambda k: F.regexp_extract_all(word, F.lit(ASSIGNED), F.lit(k))
    said = F.zip_with(F.zip_with(all_of(1), all_of(2), lambda n, v: F.struct(n.alias("n"), v.alias("v"))), all_of(3), lambda x, q: one(bare(x["v"], q), x["n"]))
    long = lambda c: (F.length(c) >= 12) & c.rlike("[0-9]")
    said = F.filter(said, lambda x: (x["candidate"] != "") & (long(x["candidate"]) | F.lower(x["name"]).rlike(NAMES)))
    spaced = before.rlike(SPACED)
    value = F.when(word.rlike(QUOTED), F.regexp_extract(word, QUOTED, 2)).otherwise(F.regexp_replace(F.regexp_extract(word, PLAIN, 1), ENDING, ""))
    rest = F.regexp_extract_all(F.regexp_replace(word, ASSIGNED, " "), F.lit(BARE), F.lit(0))
    runs = F.transform(F.filter(rest, long), lambda c: one(c, F.lit("")))
    none = F.array().cast("array<struct<candidate:string,name:string>>")
    blocks = F.when(F.coalesce(block, F.lit("")) != "", F.array(one(block, F.lit("private_key")))).otherwise(none)
    return F.array_distinct(F.concat(blocks, F.when(spaced & (value != ""), F.array(one(value, F.lit("")))).otherwise(F.concat(said, runs))))


def featured(found: DataFrame) -> DataFrame:
    c = F.col("candidate")
    near = F.lower(F.concat_ws(" ", "name", "before"))
    count = lambda pattern: F.regexp_count(c, F.lit(pattern)).cast("double")
    return found.withColumns({
        "n": F.length(c).cast("double"), "digits": count("[0-9]") / F.length(c), "uppers": count("[A-Z]") / F.length(c),
        "transitions": (count("[0-9](?=[A-Za-z])") + count("[A-Za-z](?=[0-9])") + count("[a-z](?=[A-Z])") + count("[A-Z](?=[a-z])")) / F.length(c),
        "covered": F.length(F.regexp_replace(F.lower(c), f"({GROUPS})", "")) / F.length(c),
        "path_test": F.lower("path").rlike(TESTS).cast("double"), "named": near.rlike(NAMES).cast("double"),
        "hashed": F.lower(F.concat_ws(" ", "name", "before", "after")).rlike(HASHES).cast("double"),
        "prefix": c.rlike("^(AKIA|ASIA|ghp_|gho_|sk-|sk_live|xox[bap]-|AIza)").cast("double"),
        "only_digits": c.rlike("^[0-9]+$").cast("double"), "dashes": count("[-_/]") / F.length(c),
    })


def labelled_findings(spark: SparkSession, n: int = 4000) -> DataFrame:
    """n findings by rule, from digests of their numbers: keys in assignments and with known prefixes (1), and
    card numbers, digests in their context, identifiers, dated names and keys in test paths (0)."""
    hexa = F.sha2(F.col("id").cast("string"), 256)
    mixed = F.translate(F.base64(F.unhex(hexa)), "+/=", "xyz")
    kind = F.pmod("id", F.lit(10))
    pick = lambda words, salt: F.element_at(F.array(*map(F.lit, words)), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(words))) + 1).cast("int"))
    word = pick(("the", "with", "inthe", "and", "of", "onder", "que", "les", "der", "entre"), 1)
    name = pick(("password", "token", "secret", "api_key", "passwd", "auth_token"), 2)
    size = F.element_at(F.array(*map(F.lit, (16, 18, 20, 24, 32, 40))), (F.pmod(F.xxhash64("id", F.lit(3)), F.lit(6)) + 1).cast("int"))
    digits = F.translate(hexa, "abcdef", "012345")
    rows = spark.range(0, n, 1, 1).select(
        F.when(kind.isin(0, 5), F.substring(hexa, F.lit(1), size)).when(kind == 1, F.concat(F.lit("AKIA"), F.substring(F.upper(mixed), 1, 16)))
        .when(kind == 2, F.substring(mixed, F.lit(1), size)).when(kind == 3, F.substring(hexa, F.lit(1), size))
        .when(kind == 4, F.substring(digits, 1, 16)).when(kind == 6, F.substring(hexa, F.lit(1), F.greatest(size, F.lit(32))))
        .when(kind == 7, F.concat_ws("-", F.substring(hexa, 1, 8), F.substring(hexa, 9, 4), F.substring(hexa, 13, 4), F.substring(hexa, 17, 12)))
        .when(kind == 8, F.concat(word, F.lit("ation-"), word, F.lit("ing-20"), F.substring(digits, 1, 2)))
        .otherwise(F.concat(F.substring(digits, 1, 2), word, F.lit("ement"), word)).alias("candidate"),
        F.when(kind.isin(0, 3), name).otherwise("").alias("name"),
        F.when(kind == 5, F.concat(name, F.lit(" ="))).when(kind == 2, F.concat(name, F.lit(" :")))
        .when(kind == 6, F.concat(pick(("commit", "sha256", "md5", "checksum"), 4), F.lit(" :"))).otherwise(F.concat(word, F.lit(" "), word)).alias("before"),
        word.alias("after"), F.when(kind == 3, "tests/fixtures").otherwise(F.concat(F.lit("src"), kind.cast("string"))).alias("path"),
        kind.isin(0, 1, 2, 5).cast("double").alias("label"),
    )
    return rows


def fitted(labelled: DataFrame, trees: int = 40, depth: int = 8):
    """The forest and the step that gathers its features."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    gather = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    rows = gather.transform(featured(labelled)).select("features", "label").coalesce(1)
    return gather, RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=11, featuresCol="features", labelCol="label").fit(rows)


def secret_scan(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = 0.5, **cols) -> DataFrame:
    """One row per candidate: id, pos, n_chars, sha256 (of the candidate), score, secret."""
    spark = docs.sparkSession
    gather, model = fitted(labelled if labelled is not None else labelled_findings(spark))
    found = gather.transform(featured(candidates(docs, **cols)))
    from pyspark.ml.functions import vector_to_array

    score = F.round(vector_to_array("probability")[1], 6)
    return model.transform(found).select(
        cols.get("id_col", "doc_id"), "pos", F.length("candidate").cast("long").alias("n_chars"), F.sha2("candidate", 256).alias("sha256"),
        score.alias("score"), (score >= threshold).alias("secret"),
    )
