r"""Benchmark decontamination by template canonicalisation.

Numbers, names and units of a text become typed placeholders, so a question
with other numbers or names has the template of the original.  Templates of
documents and benchmark items are cut into windows of words; windows are
matched by a hash join and then compared word by word.  Within one alignment
of a document and an item, the slots must be consistent: every value of the
item stands for one value in the document.  Where that breaks, the windows that
equal the item's count if they are enough, else the longest consistent run.  A (document, item) pair is reported if its consistent alignments cover enough windows of the item.

Names are told by their capitals: every run of capitalised words is one
placeholder in the templates, so a window does not depend on the word before it
and a name of two words aligns with a name of one.  Which of an item's capitals
are names is decided in the item: those inside a sentence, the first one, and
those that come again at sentence starts and never in lower case; wherever such
a word stands it may change.  Other capitals, such as the first word of a later
sentence, must be equal words.  Capitals depend on the case of a copy, so
windows are matched by a second rule too, in which names are case-folded words;
numbers and units are placeholders in both.  A template of few literal words,
or of few words at all, would match anything, so such windows match by equal
values.  In scripts that are written without blanks every character is a word.

Everything is DataFrame functions: one pass over the texts without an
exchange, then work on the matched windows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise
from tessera.llm.warc import small_or_shuffled

WINDOW = 8              # words of a window
MIN_WINDOWS = 6         # matched windows of an item, or all of a shorter item: 13 words in a row
MIN_ITEM_WORDS = 4      # items of fewer words match by equal words only
MARK = "\u0001"         # starts a marked word: n number, p name (q: a capital that is none), u unit, then the value
JOIN = "\u0002"         # between the words of a name
# Lao, Thai, Myanmar, Khmer, kana and Han, as a character class
UNSPACED = ("\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
            "\U00020000-\U0003ffff")
BLANKS = r"[\t\n\x0B\f\r ]"
UNITS = ("km cm mm m miles mile feet foot ft inches inch yards yard kg g mg lbs lb pounds pound tons ton liters litres "
         "liter litre l ml gallons gallon hours hour hrs hr h minutes minute mins min seconds second secs sec s days "
         "day weeks week months month years year dollars dollar usd euros euro eur cents cent percent degrees degree "
         "watts watt kw volts volt meters metres meter metre kilometers kilometres grams gram kilograms kilogram "
         "mph kmh hz khz mhz ghz kb mb gb tb")


def marked(text: Column) -> Column:
    """The lower-case words of a text joined by one space; numbers, names and
    units carry a mark and keep their value.  A name is a run of capitalised
    words with nothing but white space between them; characters of scripts
    without blanks are words of their own."""
    t = F.translate(F.coalesce(text, F.lit("")), MARK + JOIN, "  ")
    t = F.regexp_replace(t, f"([\u0e00-\U0003ffff&&[{UNSPACED}]])", " $1 ")
    t = F.lower(F.regexp_replace(t, r"(?=\p{Lu})(?<![\p{L}\p{M}\p{N}_])", f"{MARK}p"))
    t = F.regexp_replace(t, rf"({MARK}p[\p{{L}}\p{{M}}_]*+){BLANKS}++(?={MARK}p)", f"$1{JOIN}")
    t = F.replace(t, F.lit(f"{JOIN}{MARK}p"), F.lit(JOIN))
    t = F.regexp_replace(t, "(?<=[0-9])[.,:/](?=[0-9])", "_")
    t = F.regexp_replace(t, r"([0-9][0-9_]*)", rf" {MARK}n$1 ")
    t = F.regexp_replace(t, rf"(\x01n[0-9_]+)\s+({'|'.join(UNITS.split())})([^\p{{L}}]|$)", rf"$1 {MARK}u$2$3")
    # a single blank is not worth a match
    return F.trim(F.regexp_replace(t, r"[^\p{L}\p{M}\p{N}_\x01\x02]{2,}|[^ \p{L}\p{M}\p{N}_\x01\x02]", " "))


def item_names(text: Column) -> Column:
    """The first word of every name inside a sentence of an item, in lower case."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(
        rf"[\p{{Ll}}\p{{N}},;:]{BLANKS}+(\p{{Lu}}[\p{{L}}\p{{M}}_]*)"), 1), F.lower)


def settled(words: Column, inside: Column) -> Column:
    """The marked words of an item (an array) with the capitals that are no
    names marked by q: those that do not begin like a name ``inside`` a
    sentence, are not the first word, and occur once or in lower case too."""
    name = F.startswith(F.get(words, 0), F.lit(f"{MARK}p"))
    plain = F.array_distinct(F.filter(words, lambda x: ~x.startswith(MARK)))

    def settle(x: Column) -> Column:
        value = F.substring(x, 3, 2 ** 30)
        free = (F.array_contains(inside, F.substring_index(value, JOIN, 1)) | (name & (F.get(words, 0) == x))
                | ((F.size(F.filter(words, lambda y: y == x)) > 1) & ~F.array_contains(plain, value)))
        return F.when(x.startswith(f"{MARK}p") & ~free, F.concat(F.lit(f"{MARK}q"), value)).otherwise(x)
    return F.transform(words, settle)


def template(words: Column) -> Column:
    """Marked words without the values; any capital counts as a name."""
    return F.regexp_replace(words, r"\x01([npu])[^ ]*", rf"{MARK}$1")


def _item_template(word: Column) -> Column:
    return template(F.regexp_replace(word, r"^\x01q", rf"{MARK}p"))


def _split(words: Column) -> Column:
    return F.when(words == "", F.array().cast("array<string>")).otherwise(F.split(words, " "))


def window_hash(words: Column, at: Column, length: int) -> Column:
    """Hash of the ``length`` words from the place ``at`` (from 0) on."""
    return F.xxhash64(*(F.get(words, at + i) for i in range(length)))


def folded(words: Column) -> Column:
    """Marked words that do not depend on case: names are plain words, and
    every unit after a number is marked."""
    t = F.translate(F.regexp_replace(words, r"\x01[pu]", ""), JOIN, " ")
    t = F.replace(F.replace(t, F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))
    return F.regexp_replace(t, rf"(\x01n[0-9_]+) ({'|'.join(UNITS.split())})(?= |$)", rf"$1 {MARK}u$2")


def _windows(items: DataFrame, words: str, rule: int, window: int) -> DataFrame:
    w = items.select("item_id", F.col(words).alias("words")).distinct().withColumn(
        "length", F.least(F.lit(window), F.size("words")))
    w = w.select("item_id", F.lit(rule).alias("rule"), "length", "words", F.explode(F.sequence(
        F.lit(1), F.size("words") - F.col("length") + 1)).alias("at"))
    w = w.withColumn("item_window", F.slice("words", F.col("at"), F.col("length")))
    literal = F.size(F.filter("item_window", lambda x: ~x.startswith(MARK)))
    return w.withColumn("exact", (literal * 2 < F.col("length")) | (F.size("words") < MIN_ITEM_WORDS)).drop("words")


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text",
                 window: int = WINDOW) -> DataFrame:
    """(item_id, rule, at, length, hash, item_window, exact, item_windows): the
    windows of every item.  A shorter item than the window is one window.

    Rules 0 and 1 have the windows of items of at least ``MIN_ITEM_WORDS``
    words, at least half of whose words are literal.  Capitals are placeholders
    under rule 0 and folded words under rule 1.  Rule 2 has all windows of the
    items that those leave out or cut: rule 1's windows, and the windows of too
    few words or too few literal ones as ``exact`` windows, whose values must
    be equal."""
    text = marked(F.col(text_col))
    w = (items.select(F.col(id_col).alias("item_id"), _split(text).alias("words"), _split(folded(text)).alias("plain"),
                      item_names(F.col(text_col)).alias("inside"))
         .filter((F.size("words") > 0) & F.col("item_id").isNotNull()))
    w = w.withColumn("words", settled(F.col("words"), F.col("inside")))
    every = _windows(w, "plain", 2, window)
    cut = every.filter("exact").select("item_id").distinct()
    w = (_windows(w, "words", 0, window).unionByName(_windows(w, "plain", 1, window))
         .filter(~F.col("exact")).unionByName(every.join(cut, "item_id", "left_semi")))
    counts = w.groupBy("item_id", "rule").agg(F.countDistinct("at").alias("item_windows"))
    key = F.when(F.col("exact"), F.col("item_window")).otherwise(F.transform("item_window", _item_template))
    h = F.coalesce(*(F.when(F.col("length") == n, window_hash(F.col("key"), F.lit(0), n)) for n in range(1, window + 1)))
    return w.withColumn("key", key).select("item_id", "rule", "at", "length", h.alias("hash"), "item_window", "exact").join(
        counts, ["item_id", "rule"])


def doc_hashes(docs: DataFrame, lengths: list[int], exact: list[int]) -> DataFrame:
    """(doc_id, length, place, hash) of the windows of (doc_id, text) under
    all rules, with values for the lengths in ``exact``; what equals another
    form of the text is hashed once."""
    m = docs.select("doc_id", marked(F.col("text")).alias("m"))
    m = m.select("doc_id", template(F.col("m")).alias("t"), F.when(
        F.col("m").contains(f"{MARK}") | F.col("m").rlike("[ßς]"), folded(F.col("m"))).alias("v"))
    m = m.select("doc_id", "t", template(F.col("v")).alias("f"), "v")
    m = m.select("doc_id", _split(F.col("t")).alias("t"), F.when(F.col("f") != F.col("t"), _split(F.col("f"))).alias("f"),
                 F.when(F.col("v") != F.col("f"), _split(F.col("v"))).alias("v"))
    m = m.select("doc_id", F.explode(F.filter(F.array(
        *(F.struct(F.col(c).alias("words"), F.lit(c != "v").alias("each")) for c in "tfv")),
        lambda w: w["words"].isNotNull())).alias("w")).select("doc_id", "w.words", "w.each")
    # one row a word; the array stays where it is and is read by position
    m = m.select("doc_id", "each", "words", F.posexplode("words").alias("place", "word"))
    spans = F.array(*[F.struct(F.lit(n).alias("length"), F.when(
        (F.col("place") + n <= F.size("words")) & (F.col("each") | F.lit(n in exact)),
        window_hash(F.col("words"), F.col("place"), n)).alias("hash")) for n in lengths])
    if len(lengths) == 1:
        out = m.select("doc_id", F.lit(lengths[0]).alias("length"), "place", F.get(spans, 0)["hash"].alias("hash"))
    else:
        out = m.select("doc_id", "place", F.inline(spans)).select("doc_id", "length", "place", "hash")
    return out.filter(F.col("hash").isNotNull())


def _consistent(aligned: DataFrame, enough: Column) -> DataFrame:
    """Alignments with their consistent ``windows`` only: all of them, or where
    a value of the item stands for two values (``slots`` are sorted by value
    and position), the windows whose values all equal the item's if these are
    ``enough``, else these or the longest run without such a pair."""
    pairs = F.sequence(F.lit(1), F.size("slots") - 1)
    one, two = lambda i: F.get("slots", i - 1), lambda i: F.get("slots", i)
    broken = F.filter(pairs, lambda i: (one(i)["item"] == two(i)["item"]) & (one(i)["doc"] != two(i)["doc"]))
    breaks = F.when(F.size("slots") > 1, F.transform(broken, lambda i: F.struct(
        one(i)["pos"].alias("a"), two(i)["pos"].alias("b"))))
    df = aligned.withColumn("breaks", breaks)
    starts = F.array_distinct(F.concat(F.array(F.lit(0)), F.transform("breaks", lambda x: x["a"] + 1)))

    def run(start: Column) -> Column:
        end = F.array_min(F.transform(F.filter("breaks", lambda x: x["a"] >= start), lambda x: x["b"]))
        return F.filter("windows", lambda w: (w["at"] >= start) & (end.isNull() | (w["at"] + w["length"] <= end)))

    equal = F.filter("windows", lambda w: w["same"])
    runs = F.concat(F.array(F.struct((F.size(equal) >= enough).alias("enough"), F.size(equal).alias("n"), equal.alias("w"))),
                    F.transform(starts, lambda s: F.struct(F.lit(False).alias("enough"), F.size(run(s)).alias("n"),
                                                           run(s).alias("w"))))
    return df.withColumn("windows", F.when(F.size("breaks") > 0, F.array_max(runs)["w"]).otherwise(F.col("windows"))
                         ).filter(F.size("windows") > 0)


def match(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          window: int = WINDOW, min_windows: int = MIN_WINDOWS) -> DataFrame:
    """(doc_id, item_id, n_windows, item_windows, share, kind) of every
    contaminated pair; ``kind`` is ``reparameterised`` if some matched window of
    the item has other values wherever it occurs, else ``verbatim``.

    Null and empty texts, and rows with a null id, match nothing.  Rows that
    share an id are judged as one document, items that share an id as one
    item.  Other columns are ignored; empty tables give no rows.
    """
    wanted = materialise(item_windows(items, window=window), "benchmark-windows")
    valued = F.col("exact") & F.exists("item_window", lambda x: x.startswith(MARK))
    lengths = {r["length"]: r["valued"] for r in wanted.groupBy("length").agg(
        F.max(valued).alias("valued")).collect()}                                       # at most ``window`` values
    texts = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    keys = small_or_shuffled(wanted.select("hash").distinct())   # hashes of unequal lengths differ
    found = doc_hashes(texts, list(lengths) or [window], [n for n in lengths if lengths[n]]).join(keys, "hash", "left_semi").distinct()
    found = materialise(found, "benchmark-hits")
    rule = ["doc_id", "item_id", "rule"]
    pairs = found.join(wanted.select("item_id", "rule", "at", "length", "hash", "item_windows"), ["length", "hash"])
    enough = F.least(F.lit(min_windows), F.col("item_windows"))
    likely = materialise(pairs.groupBy(*rule).agg(
        F.countDistinct("at").alias("n"), F.max("item_windows").alias("item_windows")).filter(F.col("n") >= enough)
        .select(*rule), "benchmark-pairs")
    # the words of the matched documents, to compare values
    near = texts.join(small_or_shuffled(likely.select("doc_id").distinct()), "doc_id", "left_semi").select(
        "doc_id", marked(F.col("text")).alias("m")).select(
        "doc_id", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), _split(w).alias("doc_words")) for r, w in enumerate(
            [F.col("m"), folded(F.col("m")), folded(F.col("m"))])])).alias("w")).select("doc_id", "w.*")
    full = (found.join(wanted, ["length", "hash"]).join(near, ["doc_id", "rule"])
            .join(likely, rule, "left_semi")
            .withColumn("doc_window", F.slice("doc_words", F.col("place") + 1, F.col("length")))
            .filter(F.when(F.col("exact"), F.col("doc_window") == F.col("item_window")).otherwise(
                (F.transform("doc_window", template) == F.transform("item_window", _item_template))
                & F.forall(F.arrays_zip("item_window", "doc_window"), lambda z: ~z["item_window"].startswith(f"{MARK}q")
                           | (F.substring(z["item_window"], 3, 2 ** 30) == F.substring(z["doc_window"], 3, 2 ** 30))))))
    slots = F.filter(F.transform("item_window", lambda x, i: F.struct(
        x.alias("item"), (F.col("at") + i).alias("pos"), F.get("doc_window", i).alias("doc"))),
        lambda s: s["item"].startswith(MARK) & ~s["item"].startswith(f"{MARK}q"))
    aligned = (full.withColumn("slots", slots)
               .select(*rule, "item_windows", (F.col("place") - F.col("at")).alias("shift"), "slots", F.struct(
                   "at", "length", (F.size("slots") > 0).alias("slotted"),
                   F.forall("slots", lambda s: s["item"] == s["doc"]).alias("same")).alias("w"))
               .groupBy(*rule, "shift").agg(
                   F.max("item_windows").alias("item_windows"), F.collect_set("w").alias("windows"),
                   F.array_sort(F.array_distinct(F.flatten(F.collect_set("slots")))).alias("slots")))
    ats = lambda cond: F.array_distinct(F.transform(F.filter("all", cond), lambda w: w["at"]))
    slotted, same = ats(lambda w: w["slotted"]), ats(lambda w: w["slotted"] & w["same"])
    judged = (_consistent(aligned, enough).groupBy(*rule).agg(
                  F.array_distinct(F.flatten(F.collect_list("windows"))).alias("all"),
                  F.max("item_windows").alias("item_windows"))
              .withColumn("n_windows", F.size(ats(lambda w: F.lit(True))).cast("long"))
              .withColumn("changed", F.size(same) < F.size(slotted))
              .filter(F.col("n_windows") >= enough))
    # a pair that several rules report has the counts of the first
    first = judged.groupBy("doc_id", "item_id").agg(
        F.min(F.struct("rule", "n_windows", "item_windows", "changed")).alias("r")).select("doc_id", "item_id", "r.*")
    return first.select("doc_id", "item_id", "n_windows", "item_windows",
                        (F.col("n_windows") / F.col("item_windows")).alias("share"),
                        F.when(F.col("changed"), "reparameterised").otherwise("verbatim").alias("kind"))
