"""Secret scans: a wide net of candidates, and a random forest that removes the false positives.

Candidates are values of eight characters or more: words, what is glued together in them, and the values of
``key=value`` pairs anywhere inside. Without a digit they need an announcing word, mixed case, or letters that hardly
follow each other in words and low coverage. Their
features are length, character transitions, coverage by the corpus's own dictionary, path shape (of the value and of
the words beside it) and the neighbouring words: key, two words before and one behind, hashed, so that the forest
learns by itself which of them tell. It is trained on labelled findings, less every fifth value, which is held out to
measure it, and scores all candidates. DataFrame functions do all of it.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logaudit.llm.common import written

SPACE = r"[\x20\x09-\x0D]+"
#: Words that announce a secret.
ANNOUNCING = r"(?i)(password|passwd|pwd|pass[_-]?phrase|secret|token|api[_-]?key|access[_-]?key|auth|bearer|credential)"
#: Formats that are a secret by themselves, and shapes that are none.
KNOWN_SECRET = r"^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*)$"
KNOWN_OTHER = r"^([^@\s]+@[^@\s]+\.[A-Za-z.]+|\d{1,3}(\.\d{1,3}){3}|[\d().+/:-]+|https?://\S+)$"
#: A pair inside a word (looked for at each place, so that pairs may overlap), name and password in a
#: link, what glues values together, and a word of letters that has no parts.
PAIR = r"""(?<![A-Za-z0-9_.-])(?=([A-Za-z][A-Za-z0-9_.-]{0,63})["'\\]*[=:]+["'\\]*([^"'`,;?&|{}()\[\]<>\\]+))"""
USERINFO = r"://([^/:@]*):([^/@]+)@"
GLUE = r"""["'`,;?&|{}()\[\]<>\\]+"""
PLAIN = r"^[\p{L}.,;!?]+$"
#: Characters that are no part of a token, at both ends.
EDGES = r"^[^\p{L}\p{N}+/_.~$-]+|[^\p{L}\p{N}+/_=-]+$"
#: What a value has that isn't a word: a digit, an inner capital, or five consonants in a row; and what may hold one.
ODD, CONSONANTS = r"[0-9]|[a-z][A-Z]", r"(?i)[b-df-hj-np-tv-xz]{5}"
ODD_WORD = rf"{ODD}|[=:]|(?:{CONSONANTS})"
#: Share of a digit-free value in dictionary words under which consonants alone make it a candidate.
LOW_COVERAGE = 0.5
#: Occurrences from which a word belongs to the dictionary.
LEXICON_COUNT = 5
#: Labelled findings that the forest is fitted on, at most: those of least hash.
MAX_LABELLED = 20_000
TREES, DEPTH, SEED, THRESHOLD = 20, 8, 7, 0.5
#: Buckets of the neighbouring words' hashes.
BUCKETS = 128
#: Values whose hash leaves this remainder are held out.
FOLDS, HELD = 5, 1
FEATURES = [
    "f_length", "f_transitions", "f_digit_to_letter", "f_digits", "f_upper", "f_distinct", "f_hex", "f_symbols", "f_coverage",
    "f_path", "f_path_beside", "f_assigned",
]


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, word, key, value, before, after``: the values of each row, ``word`` being their word's place among
    the text's words. A word gives itself, the values of all pairs inside it and its parts between quotes, braces
    and other glue, each different value once; quotes and other characters at the ends are cut off. A value has a digit, an
    inner capital or five consonants in a row, or an announcing word beside it: ``suspicious`` is the last word on these."""
    text = F.col(text_col).cast("string")
    words = F.array_remove(F.split("t", SPACE), "")
    near = lambda w, i: F.coalesce(F.get(w, i), F.lit(""))
    wide = lambda w: F.filter(
        F.transform(
            w,
            lambda x, i: F.when(
                (F.length(x) >= 8) & (x.rlike(ODD_WORD) | (F.col("announces") & F.concat_ws(" ", near(w, i - 2), near(w, i - 1)).rlike(ANNOUNCING))),
                F.struct(i.alias("word"), x.alias("raw"), F.concat_ws(" ", near(w, i - 2), near(w, i - 1)).alias("before"), near(w, i + 1).alias("after")),
            ),
        ),
        lambda x: x.isNotNull(),
    )
    # A one-element array binds the words to a lambda's variable: they are split once.
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"), text.rlike(ANNOUNCING).alias("announces"))
    rows = rows.select("doc_id", F.explode(F.get(F.transform(F.array(words), wide), F.lit(0))).alias("c")).select("doc_id", "c.*")

    def part(raw: Column) -> Column:
        bare = F.regexp_replace(raw, r"""^["'(\[{<]+|["')\]}>.,;!?]+$""", "")
        key = F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9_-]{1,31})[=:]", 1)
        value = F.regexp_replace(F.substring(bare, F.when(key != "", F.length(key) + 2).otherwise(F.lit(1)), F.length(bare)), r"""^["']+""", "")
        trimmed = F.regexp_replace(value, EDGES, "")
        return F.struct(key.alias("key"), F.when(F.length(trimmed) >= 8, trimmed).otherwise(value).alias("value"))

    def pairs(pattern: str) -> Column:
        both = [F.regexp_extract_all("raw", F.lit(pattern), F.lit(i)) for i in (1, 2)]
        trimmed = lambda v: F.regexp_replace(v, EDGES, "")
        return F.zip_with(*both, lambda k, v: F.struct(k.alias("key"), F.when(F.length(trimmed(v)) >= 8, trimmed(v)).otherwise(v).alias("value")))

    whole = F.array(part(F.col("raw")))
    # A quoted key's word is no value as a whole.
    itself = F.filter(whole, lambda x: ~F.col("raw").rlike(r"""["'][=:]"""))
    inside = F.concat(pairs(PAIR), pairs(USERINFO), itself, F.transform(F.split("raw", GLUE), part))
    parts = F.filter(F.when(F.col("raw").rlike(PLAIN), whole).otherwise(inside), lambda x: F.length(x["value"]) >= 8)
    once = lambda p: F.filter(p, lambda x, i: F.array_position(F.transform(p, lambda y: y["value"]), x["value"]) == i + 1)
    rows = rows.select("doc_id", "word", F.explode(F.get(F.transform(F.array(parts), once), F.lit(0))).alias("p"), "before", "after")
    odd = F.col("value").rlike(rf"{ODD}|(?:{CONSONANTS})") | F.col("key").rlike(ANNOUNCING) | F.col("before").rlike(ANNOUNCING)
    return rows.select("doc_id", "word", "p.key", "p.value", "before", "after").where(odd)


def suspicious() -> Column:
    """Which values with features are candidates: those with a digit or an inner capital, announced ones, and of those
    with letters that hardly follow each other the ones that dictionary words hardly cover."""
    v = F.col("value")
    return v.rlike(ODD) | F.col("key").rlike(ANNOUNCING) | F.col("before").rlike(ANNOUNCING) | (F.col("f_coverage") < LOW_COVERAGE)


def lexicon(docs: DataFrame, text_col: str = "text", least: int = LEXICON_COUNT) -> DataFrame:
    """``run, n``: words of three letters or more that occur ``least`` times or more in all texts, lower case."""
    words = F.split(F.lower(F.col(text_col).cast("string")), r"[^\p{L}]+")
    return docs.select(F.explode(words).alias("run")).where("length(run) >= 3").groupBy("run").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def coverage(values: DataFrame, words: DataFrame) -> DataFrame:
    """``value, covered``: how many of a value's characters lie in runs of letters that are dictionary words."""
    runs = values.select("value").distinct().select("value", F.explode(F.expr(r"regexp_extract_all(lower(value), '[\\p{L}]{3,}', 0)")).alias("run"))
    return runs.join(words, "run").groupBy("value").agg(F.sum(F.length("run")).alias("covered"))


def features(found: DataFrame, words: DataFrame) -> DataFrame:
    """Candidates with the columns in ``FEATURES``, all doubles."""
    v, n = F.col("value"), F.length("value")
    share = lambda kind: F.length(F.regexp_replace(v, f"[^{kind}]+", "")) / n
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(v, r"[0-9]+", "\u0001"), r"[a-z]+", "a"), r"[A-Z]+", "A")
    flag = lambda c: c.cast("double")
    return found.join(coverage(found, words), "value", "left").select(
        "doc_id", "word", "key", "value", "before", "after",
        n.cast("double").alias("f_length"),
        (F.length(classes) / n).alias("f_transitions"),
        (F.size(F.split(v, r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])")) / n).alias("f_digit_to_letter"),
        share("0-9").alias("f_digits"),
        share("A-Z").alias("f_upper"),
        (F.size(F.array_distinct(F.split(v, ""))) / n).alias("f_distinct"),
        flag(v.rlike("^[0-9a-f]+$|^[0-9A-F]+$")).alias("f_hex"),
        (F.length(F.regexp_replace(v, r"[A-Za-z0-9]+", "")) / n).alias("f_symbols"),
        (F.coalesce("covered", F.lit(0)) / n).alias("f_coverage"),
        flag(v.rlike(r"[/\\@]|\.[A-Za-z]{2,4}$")).alias("f_path"),
        flag(F.concat_ws(" ", "before", "after").rlike(r"(^| )(/|\./|[A-Za-z]:\\)?[A-Za-z0-9_.-]+[/\\]")).alias("f_path_beside"),
        flag(F.col("before").rlike("[=:]$") | (F.col("key") != "")).alias("f_assigned"),
        neighbours().alias("words"),
    )


def neighbours() -> Column:
    """The words beside a candidate, each with its side: letters alone, lower case."""
    bare = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}]+", "")
    before = F.transform(F.split("before", " "), lambda w: F.concat(F.lit("<"), bare(w)))
    return F.concat(F.array(F.concat(F.lit("="), bare(F.col("key")))), before, F.array(F.concat(F.lit(">"), bare(F.col("after")))))


def assembled(found: DataFrame) -> DataFrame:
    """Candidates with the vector that the forest takes."""
    hashed = HashingTF(numFeatures=BUCKETS, binary=True, inputCol="words", outputCol="hashed").transform(found)
    return VectorAssembler(inputCols=[*FEATURES, "hashed"], outputCol="features").transform(hashed)


def held_out() -> Column:
    """Which candidates the forest doesn't learn from: whole values, so that no copy of one is learned."""
    return F.pmod(F.xxhash64("value"), F.lit(FOLDS)) == HELD


def known_formats(found: DataFrame) -> Column:
    """A label from formats alone: 1 for a format that is a secret, or a long hex or mixed value that is assigned
    to an announcing word; 0 for mail and network addresses, numbers and links; null for all else."""
    announced = F.col("key").rlike(ANNOUNCING) | (F.col("before").rlike(ANNOUNCING) & F.col("before").rlike("[=:]$"))
    return (
        F.when(F.col("value").rlike(KNOWN_OTHER), F.lit(0))
        .when(F.col("value").rlike(KNOWN_SECRET) | (announced & F.col("value").rlike("^(?=.*[0-9])[A-Za-z0-9+/_=-]{16,}$")), F.lit(1))
        .cast("double")
    )


def train(labelled: DataFrame, most: int = MAX_LABELLED):
    """A forest on the labelled findings (``label`` 0 or 1 and the features); None unless both labels occur.

    At most ``most`` of each label are taken, those whose value's hash is least; all copies of a value count once, and
    values that are held out don't.
    """
    rows = labelled.where("label is not null").where(~held_out()).dropDuplicates(["value", "before", "label"])
    both = None
    for label in (0.0, 1.0):
        part = rows.where(F.col("label") == label).orderBy(F.xxhash64("value", "before"), "value", "before").limit(most)
        both = part if both is None else both.union(part)
    sample = assembled(both).select("features", "label").cache()
    if sample.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, subsamplingRate=0.8)
    model = forest.fit(sample)
    sample.unpersist()
    return model


def scan(docs: DataFrame, label=known_formats, id_col: str = "doc_id", text_col: str = "text", words: DataFrame | None = None) -> DataFrame:
    """One row for each candidate: place, key, length, digest of the value, label, whether it was held out, probability
    and verdict.

    ``label`` gives the labelled findings: a column over candidates, null where none is known, or a table of findings
    (``value_sha256, label``; of findings that contradict each other the greater label counts). Values don't
    leave the scan. Null and empty texts have no candidates; copies are each reported; candidates of a very
    long text are rows like others. Without findings of both labels there is no forest, probabilities are null
    and all candidates count as secrets. Columns other than the two named are ignored.
    """
    values = written(candidates(docs, id_col, text_col), "values")
    found = features(values, lexicon(docs, text_col) if words is None else words).where(suspicious())
    if isinstance(label, DataFrame):
        told = label.groupBy("value_sha256").agg(F.max(F.col("label").cast("double")).alias("label"))
        found = found.withColumn("value_sha256", F.sha2("value", 256)).join(told, "value_sha256", "left").drop("value_sha256")
    else:
        found = found.withColumn("label", label(found))
    found = written(found, "candidates")
    model = train(found)
    if model is None:
        scored = found.withColumn("probability", F.lit(None).cast("double"))
    else:
        scored = model.transform(assembled(found)).withColumn("probability", vector_to_array("probability")[1])
    return scored.select(
        "doc_id",
        F.col("word").cast("long").alias("word"),
        "key",
        F.length("value").cast("long").alias("length"),
        F.sha2("value", 256).alias("value_sha256"),
        F.col("label").cast("int").alias("label"),
        held_out().alias("held_out"),
        "probability",
        F.coalesce(F.col("probability") >= THRESHOLD, F.lit(True)).alias("is_secret"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """All documents."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
