"""Secret scanning with a random forest that removes false positives.

A pattern finds candidates (long runs with a digit, and whatever is assigned to a secret word) with what stands around them; a forest trained on labelled findings
judges each by its length, changes of character class, dictionary coverage, path-likeness and neighbouring words.
The forest is flattened into CASE expressions, so scoring stays within SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

#: Labelled findings that the forest is trained on, at most.
TRAIN_ROWS = 20_000
_CLASS = "[A-Za-z0-9_+/=-]"
#: A run of 16 or more key characters with a digit.
_CANDIDATE = rf"(?<!{_CLASS})(?=[A-Za-z_+/=-]*[0-9]){_CLASS}{{16,}}"
_BEFORE, _AFTER = 40, 16
#: Words that announce a secret, and words that announce other long values.
_SECRET_WORDS = r"(?i)(token|secret|passw|pwd|api.?key|auth|credential|private|bearer|access.?key)"
_OTHER_WORDS = r"(?i)(sha\d*|md5|commit|checksum|digest|uuid|guid|order|card|phone|invoice|tracking|isbn|version|http|www)"
#: An assignment to a name with a secret word, and what is assigned: up to the closing quote, or to the next space or quote.
_ASSIGNED = r"(?:" + _SECRET_WORDS.replace("(?i)(", "(?i:") + r"[\w.-]{0,20}[\"']?[ \t]{0,3}[:=][ \t]{0,3})"
_BARE = r"[^\s\"']*[^\s\"',;.:)\]}]"
FEATURES = ("length", "digits", "capitals", "changes", "distinct", "hex", "separators", "slashes", "covered", "secret_word", "other_word", "assigned", "quoted")


def candidates(documents: DataFrame) -> DataFrame:
    """doc_id, place (among the document's candidates), candidate, before, after for whole texts.

    Null and empty texts have none; one that occurs again is another candidate, with its own place.
    """
    some = documents.select("doc_id", "text").filter(F.col("text").rlike(_CANDIDATE) | F.col("text").rlike(rf"{_ASSIGNED}[\"']?[^\s\"']"))
    # a lookbehind takes the shortest fit, so the context either fills its size or begins its line
    before = rf"((?:^|(?<=\n))[^\n]{{0,{_BEFORE - 1}}}|[^\n]{{{_BEFORE}}})"
    run = rf"(?<!{_CLASS})(?=[A-Za-z_+/=-]*[0-9])(?={_CLASS}{{16}})"
    # whatever is assigned to a secret word, of any length and sign; the first test is a cheap one
    values = [rf"(?<={_ASSIGNED}{q})(?![{q} \t])[^{q}\n]+(?={q})" for q in "\"'"] + [rf"(?<={_ASSIGNED}[\"']?){_BARE}"]
    given = rf"(?<=[:=][ \t]{{0,3}}[\"']?)(?:{'|'.join(f'(?={v})' for v in values)})"
    around = rf"(?:{run}|{given})(?<={before})({'|'.join(values)}|{_CLASS}+)(?=([^\n]{{0,{_AFTER}}}))"
    parts = [F.regexp_extract_all("text", F.lit(around), i).alias(n) for i, n in ((2, "candidate"), (1, "before"), (3, "after"))]
    zipped = some.select("doc_id", *parts).select("doc_id", F.posexplode(F.arrays_zip("candidate", "before", "after")).alias("place", "at"))
    return zipped.select("doc_id", "place", "at.*")


def dictionary(*texts: DataFrame) -> DataFrame:
    """word: the different words of three or more letters a-z in the given tables' texts; null and empty texts have none."""
    words = None
    for t in texts:
        own = t.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(?<![\p{L}])([a-z]{3,})(?![\p{L}])"), 1)).alias("word"))
        words = own if words is None else words.unionByName(own)
    return words.distinct()


def features(found: DataFrame, words: DataFrame) -> DataFrame:
    """found (candidate, before, after and more) with FEATURES as doubles."""
    c, low = F.col("candidate"), F.lower("candidate")
    size = F.length(c).cast("double")
    parts = found.select("candidate").distinct().select("candidate", F.explode(F.regexp_extract_all(low, F.lit(r"([a-z]{3,})"), 1)).alias("word"))
    cover = parts.join(words, "word", "left_semi").groupBy("candidate").agg(F.sum(F.length("word")).alias("letters")).withColumnRenamed("candidate", "_candidate")
    joined = found.join(cover, F.col("candidate") == F.col("_candidate"), "left").drop("_candidate")

    def count(pattern: str) -> Column:
        return F.regexp_count(c, F.lit(pattern)).cast("double")

    def flag(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(False)).cast("double")

    columns = {
        "length": size,
        "digits": count("[0-9]") / size,
        "capitals": count("[A-Z]") / size,
        "changes": count(r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])") / size,
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / size,
        "hex": flag(c.rlike("^[0-9a-f]+$") | c.rlike("^[0-9A-F]+$")),
        "separators": count("[_=+-]") / size,
        "slashes": count("/"),
        "covered": F.coalesce("letters", F.lit(0)) / size,
        "secret_word": flag(F.col("before").rlike(_SECRET_WORDS)),
        "other_word": flag(F.col("before").rlike(_OTHER_WORDS)),
        "assigned": flag(F.col("before").rlike(r"[:=]\s*[\"']?$")),
        "quoted": flag(F.col("before").rlike("[\"']$") & F.col("after").rlike("^[\"']")),
    }
    return joined.withColumns(columns).drop("letters")


def example_findings(spark: SparkSession, n: int = 4000) -> DataFrame:
    """candidate, before, after, label (1: a secret): n findings made from hashes of their number.

    Stands in where no labelled findings of one's own are at hand: keys in hexadecimal and base 64
    after an assignment or a secret word, against digests, numbers, identifiers and paths.
    """
    i = F.col("id")
    a, b = F.sha2(F.concat(F.lit("a"), i.cast("string")), 256), F.sha2(F.concat(F.lit("b"), i.cast("string")), 256)
    number = F.substring(F.regexp_replace(F.concat(a, b), "[a-f]", ""), 1, 16)
    base64 = F.regexp_replace(F.base64(F.unhex(F.substring(a, 1, 48))), "[+/=]", "x")
    word = F.element_at(F.array(*[F.lit(x) for x in ("token", "api_key", "secret", "password", "access_key", "auth_token")]), (F.pmod(F.xxhash64("id"), F.lit(6)) + 1).cast("int"))
    other = F.element_at(F.array(*[F.lit(x) for x in ("commit", "sha256", "order", "checksum", "the", "number", "version", "see")]), (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(8)) + 1).cast("int"))
    name = F.concat(F.lit("release_notes_for_"), F.lit("build-"), F.substring(number, 1, 4))
    password = F.concat(F.lit("Tr"), F.substring(a, 1, 5), F.lit("&"), F.substring(b, 1, 2), F.lit("!"))
    plain = F.element_at(F.array(*[F.lit(x) for x in ("required", "none", "the", "changed", "your", "missing")]), (F.pmod(F.xxhash64("id", F.lit(3)), F.lit(6)) + 1).cast("int"))
    path = F.concat(F.lit("usr/share/data/part-"), F.substring(number, 1, 5))
    kinds = [
        (F.substring(a, 1, 40), F.concat(word, F.lit(' = "')), F.lit('"'), 1),
        (F.substring(a, 1, 32), F.concat(word, F.lit(": ")), F.lit(" "), 1),
        (base64, F.concat(word, F.lit("=")), F.lit(""), 1),
        (F.concat(F.lit("sk-"), base64), F.concat(F.lit("use "), word, F.lit(' "')), F.lit('",'), 1),
        (password, F.concat(word, F.lit(' = "')), F.lit('"'), 1),
        (password, F.concat(word, F.lit(": ")), F.lit(""), 1),
        (plain, F.concat(word, F.lit(": ")), F.lit(" by"), 0),
        (number, F.concat(other, F.lit(" ")), F.lit(" and"), 0),
        (number, F.concat(word, F.lit(" of ")), F.lit(" the"), 0),
        (F.substring(a, 1, 40), F.concat(other, F.lit(" ")), F.lit(" was"), 0),
        (a, F.concat(other, F.lit(": ")), F.lit(""), 0),
        (name, F.concat(other, F.lit(" ")), F.lit(" is"), 0),
        (path, F.concat(other, F.lit(" /")), F.lit("/x"), 0),
    ]
    kind = F.pmod(i, F.lit(len(kinds)))
    fields = []
    for at, label in enumerate(("candidate", "before", "after", "label")):
        value = None
        for k, row in enumerate(kinds):
            piece = row[at] if at < 3 else F.lit(row[3])
            value = F.when(kind == k, piece) if value is None else value.when(kind == k, piece)
        fields.append(value.alias(label))
    return spark.range(n).select(*fields)


def train(labelled: DataFrame, words: DataFrame, trees: int = 20, depth: int = 6, rows: int = TRAIN_ROWS) -> list[str]:
    """One SQL expression for each tree of a forest: the probability that a finding is a secret.

    labelled: candidate, before, after, label. At most `rows` of them are used, by hash.
    Without both labels the single expression is 1, which keeps every candidate.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    bounded = labelled.filter("label IS NOT NULL AND candidate IS NOT NULL").orderBy(F.xxhash64("candidate", "before"), "candidate", "before").limit(rows)
    table = features(materialize(bounded, "labelled"), words).select(*FEATURES, F.col("label").cast("double"))
    table = materialize(table, "findings")
    if table.select("label").distinct().count() < 2:
        return ["1.0D"]
    assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="v").transform(table)
    forest = RandomForestClassifier(featuresCol="v", labelCol="label", numTrees=trees, maxDepth=depth, seed=7, cacheNodeIds=False).fit(assembled)
    return [_case(tree._call_java("rootNode")) for tree in forest.trees]


def _case(node) -> str:
    if node.numDescendants() == 0:
        stats = list(node.impurityStats().stats())
        return f"{stats[1] / max(sum(stats), 1e-9):.6f}D"
    split = node.split()
    name = FEATURES[split.featureIndex()]
    return f"CASE WHEN {name} <= {split.threshold()!r}D THEN {_case(node.leftChild())} ELSE {_case(node.rightChild())} END"


def scan(documents: DataFrame, forest: list[str], words: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, place, candidate, before, after, probability, is_secret: one row per candidate.

    Null and empty texts have no candidates; equal rows give equal findings as often as they
    occur; a table without candidates gives no rows. Columns besides doc_id and text are not used.
    """
    # found once: their features need them twice
    judged = features(materialize(candidates(documents), "candidates"), words)
    for i, tree in enumerate(forest):
        judged = judged.withColumn(f"_t{i}", F.expr(tree))
    mean = sum((F.col(f"_t{i}") for i in range(len(forest))), F.lit(0.0)) / len(forest)
    return judged.select("doc_id", F.col("place").cast("long"), "candidate", "before", "after", F.round(mean, 6).alias("probability"), (mean >= threshold).alias("is_secret"))
