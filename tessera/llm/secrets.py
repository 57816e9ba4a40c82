r"""Secret scan: rules find candidates, a random forest removes false positives.

Rules mark every candidate of a text in one pass: values assigned to password,
token or key names, long strings that mix letters and digits, and private-key
headers.  Each candidate is described by its length, character transitions,
character shares, known key formats, how much of it dictionary words cover,
the path of its document, and the neighbouring words (those within ``CONTEXT``
characters before and after it).  A random forest trained
on labelled findings scores it.

Everything is DataFrame functions and Spark ML.  Texts are read without an
exchange; only candidates (with a few dozen characters of context) move.  The
dictionary is the corpus itself: the letter runs of the candidates are counted
as whole words of all texts.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import fresh, materialise
from tessera.llm.warc import BROADCAST_ROWS, small_or_shuffled

OPEN, CLOSE, LOST = "\u0002", "\u0003", "�"
CONTEXT = 48                # characters of neighbouring text kept with a candidate
MIN_WORD_COUNT = 3          # a dictionary word occurs at least so often
KEY_NAMES = (r"passwords?|passwd|pwd|passphrase|secrets?|tokens?|api[_-]?keys?|access[_-]?keys?|auth[_-]?keys?|"
             r"private[_-]?keys?|credentials?")
_CHARS = "[A-Za-z0-9+/_-]"
CANDIDATE = (rf"((?i:(?:{KEY_NAMES})[\"']?\s{{0,3}}[:=]\s{{0,3}}[\"']?))([A-Za-z0-9+/_.~!@#$%^&*-]{{6,}}=*)"
             rf"|((?<!{_CHARS})(?={_CHARS}*[0-9])(?={_CHARS}*[A-Za-z]){_CHARS}{{16,}}={{0,2}}"
             r"|-----BEGIN [A-Z ]*PRIVATE KEY-----)")
KEY_FORMAT = (r"^(AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[baprs]-[A-Za-z0-9-]{10,}|"
              r"AIza[0-9A-Za-z_-]{35}|sk-[A-Za-z0-9-]{20,}|eyJ[A-Za-z0-9_-]{10,}.*|-----BEGIN.*)$")
# words, not parts of host names or addresses
HARMLESS = (r"(?i)(?<![.@\w/-])(example|sample|dummy|test|placeholder|commit|revision|sha-?1|sha-?256|md5|checksum|hash|digest|"
            r"uuid|guid|isbn|doi|version|build|order|invoice|serial|ticket|etag|urn|file|path|slug|href|src|image)(?![.@\w-])")
HARMLESS_PATH = r"(?i)(^|[/_.-])(tests?|examples?|samples?|fixtures?|mocks?|docs?|vendor|node_modules|lock)([/_.-]|$)"
PLACEHOLDER = r"(?i)(changeme|your|example|xxxx|placeholder|dummy|sample|redacted|\*\*\*|\.\.\.|123456|qwerty)"
FEATURES = ["n_chars", "transitions", "digits", "uppers", "marks", "distinct", "is_hex", "is_uuid", "known_format",
            "word_cover", "key_before", "assigned", "quoted", "harmless_near", "placeholder", "path_harmless"]
THRESHOLD = 0.5
TRAIN_PARTITIONS = 8        # of the labelled findings


def _pieces(text: str) -> Column:
    """The text cut before each candidate; a piece after the first begins with
    the candidate and a closing mark."""
    plain = F.translate(F.coalesce(F.col(text), F.lit("")), OPEN + CLOSE, LOST + LOST)
    return F.split(F.regexp_replace(plain, CANDIDATE, f"$1{OPEN}$2$3{CLOSE}"), OPEN)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               path_col: str | None = None) -> DataFrame:
    """(doc_id, text_key, no, start, candidate, before, after, path) of every
    candidate of every whole text; ``start`` counts code points.  Null and
    empty texts have none; repeated rows count once."""
    path = F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")
    p = docs.select(F.col(id_col).alias("doc_id"), path.alias("path"), F.col(text_col).alias("text"))
    p = p.withColumn("pieces", _pieces("text")).filter(F.size("pieces") > 1)
    p = p.select("doc_id", "path", F.md5("text").alias("text_key"), "pieces")
    tail = lambda x: F.substring_index(x, CLOSE, -1)
    cut = F.transform("pieces", lambda x, i: F.struct(
        i.alias("no"), F.length(F.replace(x, F.lit(CLOSE), F.lit(""))).alias("size"),
        F.when(i > 0, F.substring_index(x, CLOSE, 1)).alias("candidate"),
        F.when(i > 0, F.right(tail(F.get("pieces", i - 1)), F.lit(CONTEXT))).alias("before"),
        F.substring(tail(x), 1, CONTEXT).alias("after")))
    rows = p.select("doc_id", "text_key", "path", F.inline(cut)).distinct()
    so_far = Window.partitionBy("doc_id", "text_key", "path").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum("size").over(so_far), F.lit(0))).filter("no > 0").drop("size")


def letter_runs(candidate: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(candidate), "[^a-z]+"), lambda x: F.length(x) >= 3))


def dictionary(docs: DataFrame, runs: DataFrame, text_col: str = "text",
               min_count: int = MIN_WORD_COUNT, max_runs: int = BROADCAST_ROWS) -> DataFrame:
    """The letter runs (column ``word``) that are words of the texts, counted
    over all of them.  Runs too many to broadcast meet the counted words, so
    occurrences are not shuffled."""
    words = docs.select(F.explode(F.split(F.lower(F.col(text_col)), r"[^\p{L}\p{N}_+/=-]+")).alias("word"))
    if runs.limit(max_runs + 1).count() <= max_runs:
        words, runs = words.join(F.broadcast(runs), "word", "left_semi"), None
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count).select("word")
    return counted if runs is None else counted.join(runs, "word", "left_semi")


def describe(cands: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The candidates with their ``FEATURES``."""
    keyed = cands.withColumn("runs", letter_runs(F.col("candidate")))
    each = keyed.select("candidate", F.explode("runs").alias("word")).distinct()
    each = materialise(each, "secret-runs")
    known = dictionary(docs, materialise(each.select("word").distinct(), "secret-words"), text_col)
    cover = (each.join(known, "word").groupBy("candidate").agg(F.sum(F.length("word")).alias("covered")))
    c = F.col("candidate")
    n = F.length(c)
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(
        c, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0"), "[^aA0]", "_")
    share = lambda pattern: F.length(F.regexp_replace(c, pattern, "")) / n
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    return keyed.join(cover, "candidate", "left").select(
        "*", n.cast("double").alias("n_chars"),
        ((F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) - 1) / F.greatest(n - 1, F.lit(1))).alias("transitions"),
        share("[^0-9]").alias("digits"), share("[^A-Z]").alias("uppers"), share("[A-Za-z0-9]").alias("marks"),
        (F.size(F.array_distinct(F.split(c, ""))) / n).alias("distinct"),
        flag(c.rlike("(?i)^[0-9a-f]+$")).alias("is_hex"),
        flag(c.rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")).alias("is_uuid"),
        flag(c.rlike(KEY_FORMAT)).alias("known_format"),
        F.least(F.lit(1.0), F.coalesce(F.col("covered"), F.lit(0)) / n).alias("word_cover"),
        flag(F.col("before").rlike(rf"(?i)(?:{KEY_NAMES})\W*$")).alias("key_before"),
        flag(F.col("before").rlike(r"[:=]\s*[\"']?$")).alias("assigned"),
        flag(F.col("before").rlike(r"[\"']$") & F.col("after").rlike(r"^[\"']")).alias("quoted"),
        flag(F.col("before").rlike(HARMLESS)).alias("harmless_near"), flag(c.rlike(PLACEHOLDER)).alias("placeholder"),
        flag(F.col("path").rlike(HARMLESS_PATH)).alias("path_harmless"))


def labelled_findings(spark: SparkSession, rows: int = 4000) -> DataFrame:
    """Labelled findings (candidate, before, after, path, label) made from a
    rule: keys of the usual kinds in the places where they leak, and the
    look-alikes that scanners report by mistake.  ``rows`` bounds the sample;
    the same findings come out on every run."""
    h, up = F.sha2(F.col("id").cast("string"), 512), F.upper(F.sha2(F.concat(F.lit("u"), "id"), 256))
    b64 = F.base64(F.unhex(F.sha2(F.concat(F.lit("b"), "id"), 384)))
    words = "the value of this field must not be changed by hand see notes".split()
    pick = lambda k: F.element_at(F.array(*map(F.lit, words)), (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(words))) + 1).cast("int"))
    slug = F.concat_ws("-", pick(1), pick(2), pick(3), pick(4), F.substring(F.conv(F.substring(h, 1, 4), 16, 10), 1, 4))
    uuid = F.concat_ws("-", *(F.substring(h, a, b) for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    akia = F.concat(F.lit("AKIA"), F.substring(F.translate(up, "0189", "XYZQ"), 1, 16))
    size = (F.pmod(F.xxhash64("id", F.lit("n")), F.lit(25)) + 16).cast("int")
    text = F.concat_ws(" ", pick(5), pick(6), pick(7))
    kinds = [  # candidate, text before, text after, label; the first one with a path of tests
        (F.substring(h, F.lit(1), size), F.concat(text, F.lit(" token = \"")), F.lit("\" "), 0),
        (F.substring(h, F.lit(1), size), F.concat(text, F.lit(" password=")), F.lit(" "), 1),
        (F.substring(h, F.lit(1), size), F.concat(text, F.lit(" token = \"")), F.lit("\" "), 1),
        (F.upper(F.substring(h, F.lit(1), size)), F.concat(text, F.lit(" TOKEN = \"")), F.lit("\" "), 1),
        (b64, F.concat(text, F.lit(" secret: ")), F.lit(" "), 1),
        (akia, F.concat(text, F.lit(" ")), F.lit(" "), 1),
        (F.concat(F.lit("ghp_"), F.substring(b64, 1, 36)), F.concat(text, F.lit(" ")), F.lit(" "), 1),
        (b64, F.concat(text, F.lit(" ")), F.lit(" "), 1),
        (F.substring(h, F.lit(1), size), F.concat(text, F.lit(" ")), F.lit(" "), 1),
        (F.substring(h, 1, 40), F.concat(text, F.lit(" commit ")), F.lit(" "), 0),
        (F.substring(h, 1, 64), F.concat(text, F.lit(" sha256: ")), F.lit(" "), 0),
        (F.substring(h, 1, 32), F.concat(text, F.lit(" md5 ")), F.lit(" "), 0),
        (uuid, F.concat(text, F.lit(" id ")), F.lit(" "), 0),
        (slug, F.concat(text, F.lit(" ")), F.lit(" "), 0),
        (F.concat_ws("/", pick(1), pick(2), pick(3), pick(4), F.lit("v2")), F.concat(text, F.lit(" path ")), F.lit(" "), 0),
        (F.concat(pick(1), F.lit("your"), pick(2), F.lit("123456")), F.concat(text, F.lit(" password=")), F.lit(" "), 0),
        (F.concat(pick(1), F.lit("ing"), pick(2)), F.concat(text, F.lit(" token: ")), F.lit(" "), 0),
        (F.concat(pick(1), pick(2), pick(3), F.lit("20")), F.concat(text, F.lit(" ")), F.lit(" "), 0),
    ]
    kind = F.pmod("id", F.lit(len(kinds)))
    chosen = F.element_at(F.array(*(F.struct(c.alias("candidate"), b.alias("before"), a.alias("after"),
                                             F.lit(y).alias("label")) for c, b, a, y in kinds)), (kind + 1).cast("int"))
    path = F.when(kind == 0, "tests/fixtures/keys.txt").when(F.pmod("id", F.lit(3)) == 0, "src/app/settings.py")
    return spark.range(0, rows, 1, 2).select(F.inline(F.array(chosen)), path.alias("path"))


def train(described: DataFrame, trees: int = 20, depth: int = 6) -> PipelineModel:
    """The forest over findings that carry ``label`` 0 or 1.  Rows are dealt by
    their values and sorted inside a partition, so the same findings give the
    same forest however their table was cut."""
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7, labelCol="label", featuresCol="features")
    rows = ready.transform(described.select(F.col("label").cast("double"), *FEATURES)
                           .repartition(TRAIN_PARTITIONS, "label", *FEATURES).sortWithinPartitions("label", *FEATURES))
    return PipelineModel([ready, forest.fit(rows)])


def scan(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
         path_col: str | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text_key, no, start, n_chars, candidate, score) of every
    candidate whose score is at least ``threshold``."""
    found = materialise(candidates(docs, id_col, text_col, path_col), "secret-candidates")
    known = labelled_findings(docs.sparkSession) if labelled is None else labelled
    both = found.withColumn("label", F.lit(None).cast("int")).unionByName(known, allowMissingColumns=True)
    described = materialise(describe(both, docs, text_col), "secret-features")
    model = train(described.filter("label is not null"))
    scored = model.transform(described.filter("label is null")).withColumn(
        "score", vector_to_array("probability")[1])
    return scored.filter(F.col("score") >= threshold).select(
        "doc_id", "text_key", "no", "start", F.col("n_chars").cast("long"), "candidate", "score")


def redact(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found secret of a text replaced by ``mask`` and no
    other character changed; all rows and columns are kept, whatever their
    names."""
    key, digest, places = (fresh(docs, c) for c in ("_id", "_key", "_places"))
    spots = found.groupBy(F.col("doc_id").alias(key), F.col("text_key").alias(digest)).agg(
        F.collect_set(F.struct("no", F.col("start").cast("int").alias("start"), F.col("n_chars").cast("int").alias("n"))).alias(places))
    spots = small_or_shuffled(materialise(spots, "secret-places"))
    text, found_here = F.col(text_col), F.sort_array(places)
    hidden = F.array_join(F.transform(_pieces(text_col), lambda x, i: F.when(
        F.exists(places, lambda p: p["no"] == i), F.concat(F.lit(mask), F.substring_index(x, CLOSE, -1)))
        .otherwise(F.replace(x, F.lit(CLOSE), F.lit("")))), "")
    # a text that holds a mark itself is cut by offsets
    end = lambda p: p["start"] + p["n"]
    before = lambda i: F.when(i == 0, 0).otherwise(end(F.get(found_here, i - 1)))
    cut = F.array_join(F.transform(found_here, lambda p, i: F.concat(
        F.substring(text, before(i) + 1, p["start"] - before(i)), F.lit(mask))), "")
    rest = F.substring(text, end(F.element_at(found_here, -1)) + 1, F.length(text))
    marked = text.contains(OPEN) | text.contains(CLOSE)
    joined = docs.join(spots, F.col(id_col).eqNullSafe(F.col(key)) & (F.md5(text_col) == F.col(digest)), "left")
    clean = F.when(F.col(places).isNull(), text).when(marked, F.concat(cut, rest)).otherwise(hidden)
    return joined.select(*(clean.alias(c) if c == text_col else docs[c] for c in docs.columns))
