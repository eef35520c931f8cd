"""Benchmark passages in training text, found in a positional inverted index of the training tokens.

The index holds a posting (term, document, position) for every occurrence of a test term in the corpus. It is built
where the text lies: each task writes one segment whose postings are sorted by term, document and position, so a scan for
a term skips the row groups of others and nothing is shuffled. A phrase is searched from its two rarest terms: their
lists are intersected after shifting one by the offset between them. What survives names a document, an item and the
diagonal on which they meet, and there the lists of all the item's terms are intersected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowcast.llm.common import RAW_WORD, Scratch, lower_ascii, table

WINDOW = 10
_DOCUMENT = -1  # the pseudo term under which each document has one posting, with its number of words as position


def words(text: Column) -> Column:
    """The words of a text in order, case as it stands; a null text has none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(f"({RAW_WORD})"), F.lit(1)), F.array().cast("array<string>"))


def item_words(items: DataFrame) -> DataFrame:
    """One row per word of an item: item (a number of its own per row), item_id, at, word, n (words of the item)."""
    w = items.select("item_id", words(F.col("text")).alias("ws")).withColumn("item", F.monotonically_increasing_id())
    return w.select("item", "item_id", F.size("ws").alias("n"), F.posexplode("ws").alias("at", "raw")).select(
        "item", "item_id", "n", "at", lower_ascii(F.col("raw")).alias("word"))


def build_index(docs: DataFrame, terms: DataFrame, row: Column | None = None) -> DataFrame:
    """Postings (term, doc, doc_id, position) of every word of ``docs`` that ``terms`` (word, term) names.

    ``doc`` numbers the rows of ``docs`` (``row``, if they have a stored number), so repeated rows and null identifiers stay apart. The posting of the pseudo
    term carries doc_id and the number of words.
    """
    number = F.monotonically_increasing_id() if row is None else row
    read = docs.select("doc_id", words(F.col("text")).alias("ws"), number.alias("doc"))
    # The empty word first: it becomes the document's own posting.
    rows = read.select("doc", "doc_id", F.size("ws").alias("n_words"), F.posexplode(F.concat(F.array(F.lit("")), "ws")).alias("at", "raw"))
    rows = rows.select("doc", "doc_id", "n_words", "at", lower_ascii(F.col("raw")).alias("word"))
    own = F.col("at") == 0
    return rows.join(terms, "word").select(
        "term", "doc", F.when(own, F.col("doc_id")).alias("doc_id"), F.when(own, F.col("n_words")).otherwise(F.col("at") - 1).alias("position"),
    ).sortWithinPartitions("term", "doc", "position")


def _postings(index: DataFrame) -> DataFrame:
    return index.where(F.col("term") != _DOCUMENT).select("term", "doc", "position")


def phrase_seeds(test: DataFrame, frequency: DataFrame, window: int) -> DataFrame:
    """Per distinct pair: item, at1, term1, at2, term2 -- the two rarest words of some window of the item.

    Windows with a word that the corpus lacks cannot occur and have no pair. A window of one word pairs it with itself.
    """
    size = F.least(F.col("n"), F.lit(window))
    starts = test.join(frequency, "term").select(
        "item", "at", "term", "count", size.alias("size"),
        F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") - size + 1), F.least(F.col("at"), F.col("n") - size))).alias("start"))
    rank = Window.partitionBy("item", "start").orderBy("count", "at")
    ranked = starts.withColumn("rank", F.row_number().over(rank)).withColumn("found", F.count(F.lit(1)).over(Window.partitionBy("item", "start")))
    first, second = (F.max(F.when(F.col("rank") == F.least(F.lit(r), F.col("size")), F.struct("at", "term"))) for r in (1, 2))
    pairs = ranked.where("found = size").groupBy("item", "start").agg(first.alias("a"), second.alias("b"))
    return pairs.select("item", F.col("a.at").alias("at1"), F.col("a.term").alias("term1"), F.col("b.at").alias("at2"), F.col("b.term").alias("term2")).distinct()


def phrase_runs(index: DataFrame, test: DataFrame, scratch: Scratch, window: int = WINDOW) -> DataFrame:
    """Every stretch of a document that equals ``window`` or more consecutive words of an item (all of a shorter item).

    Returns doc, item, first_word, last_word (positions in the document) and item_word (position in the item).
    """
    postings = _postings(index)
    frequency = scratch.put(postings.groupBy("term").agg(F.count(F.lit(1)).alias("count")), "frequency")
    seeds = scratch.put(phrase_seeds(test, frequency, window), "seeds")
    one = postings.join(seeds, postings.term == seeds.term1).select(
        "doc", "item", (F.col("position") - F.col("at1")).alias("diagonal"), "term2", (F.col("position") - F.col("at1") + F.col("at2")).alias("position2"))
    other = postings.join(seeds.select("term2").distinct(), F.col("term") == F.col("term2"), "left_semi")
    met = one.join(other, (one.doc == other.doc) & (one.term2 == other.term) & (one.position2 == other.position), "left_semi")
    met = scratch.put(met.select("doc", "item", "diagonal").distinct(), "met")

    near = postings.join(met.select("doc").distinct(), "doc", "left_semi")
    wanted = met.join(test.select("item", "n", "at", "term"), "item").select(
        "doc", "item", "diagonal", "n", "at", "term", (F.col("diagonal") + F.col("at")).alias("position"))
    found = wanted.join(near, ["doc", "term", "position"], "left_semi")
    line = Window.partitionBy("doc", "item", "diagonal").orderBy("at")
    runs = found.withColumn("run", F.col("at") - F.row_number().over(line)).groupBy("doc", "item", "diagonal", "run").agg(
        F.min("at").alias("item_word"), F.count(F.lit(1)).alias("length"), F.first("n").alias("n"))
    return runs.where(F.col("length") >= F.least(F.col("n"), F.lit(window))).select(
        "doc", "item", (F.col("diagonal") + F.col("item_word")).alias("first_word"),
        (F.col("diagonal") + F.col("item_word") + F.col("length") - 1).alias("last_word"), "item_word")


def proximity_matches(index: DataFrame, test: DataFrame, slop: int) -> DataFrame:
    """Places where all distinct words of an item lie within ``slop`` words of an occurrence of its rarest one.

    Returns doc, item, anchor, first_word, last_word (the span of the nearest words found). Matching goes by cells of
    ``slop`` positions, so no list is paired with the whole of another.
    """
    postings = _postings(index)
    frequency = postings.groupBy("term").agg(F.count(F.lit(1)).alias("count"))
    terms = test.select("item", "term").distinct().join(frequency, "term")
    rarest = terms.groupBy("item").agg(F.min_by("term", F.struct("count", "term")).alias("term"))
    needed = test.groupBy("item").agg(F.countDistinct("term").alias("needed"))
    width = max(1, slop)
    anchors = postings.join(rarest, "term").select("doc", "item", F.col("position").alias("anchor"))
    wanted = anchors.join(terms.select("item", "term"), "item").withColumn("cell", F.explode(F.array(*[F.floor(F.col("anchor") / width) + d for d in (-1, 0, 1)])))
    near = postings.withColumn("cell", F.floor(F.col("position") / width)).join(wanted, ["doc", "term", "cell"])
    near = near.where(F.abs(F.col("position") - F.col("anchor")) <= slop)
    closest = near.groupBy("doc", "item", "anchor", "term").agg(F.min_by("position", F.struct(F.abs(F.col("position") - F.col("anchor")), "position")).alias("position"))
    spans = closest.groupBy("doc", "item", "anchor").agg(
        F.count(F.lit(1)).alias("terms"), F.min("position").alias("first_word"), F.max("position").alias("last_word"))
    return spans.join(needed, "item").where("terms = needed").select("doc", "item", "anchor", "first_word", "last_word")


def prepare(docs: DataFrame, items: DataFrame, scratch: Scratch, row: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The stored index of ``docs`` over the words of ``items``, and the numbered words of the items."""
    said = scratch.put(item_words(items), "item-words")
    order = Window.orderBy("word")  # the distinct words of the test set alone
    terms = said.select("word").distinct().withColumn("term", F.row_number().over(order))
    terms = scratch.put(terms.unionByName(docs.sparkSession.createDataFrame([("", _DOCUMENT)], "word string, term int")), "terms")
    test = scratch.put(said.join(terms, "word").select("item", "item_id", "n", "at", "term"), "test")
    return scratch.put(build_index(docs, terms, row), "index"), test


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, row: Column | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, row (a number of the row: the given
    stored one, or one that holds for this result only).

    Null and empty texts have no words and no hits. Items without words match nothing; a null item_id counts as a hit but
    is not listed. Repeated documents and items are matched each for itself. Empty tables give no rows, or rows without
    hits. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "decontamination")
    index, test = prepare(docs, items, scratch, row)
    runs = scratch.put(phrase_runs(index, test, scratch, window), "runs")
    hit = runs.select("doc", F.explode(F.sequence("first_word", "last_word")).alias("position")).distinct()
    hit = hit.groupBy("doc").agg(F.count(F.lit(1)).alias("n_hit"))
    named = runs.join(test.select("item", "item_id").distinct(), "item").where("item_id IS NOT NULL").select("doc", F.col("item_id").cast("string").alias("name")).distinct()
    named = named.groupBy("doc").agg(F.sort_array(F.collect_list("name")).alias("names"))
    rows = index.where(F.col("term") == _DOCUMENT).select("doc", "doc_id", F.col("position").cast("long").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return scratch.keep(rows.join(hit, "doc", "left").join(named, "doc", "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce(F.array_size("names"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.concat_ws(",", "names"), F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), F.col("doc").alias("row")))


def query(spark: SparkSession, folder: str) -> DataFrame:
    return contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("row")


SQL = r"""
WITH ww AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (SELECT item_id, list_slice(ws, s + 1, s + least(10, len(ws))) AS g, least(10, len(ws)) AS k
  FROM (SELECT item_id, ws, unnest(range(0, greatest(len(ws) - 9, 1))) AS s FROM ww WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT k FROM win),
dw AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents),
gr AS (SELECT doc_id, k, s, list_slice(ws, s + 1, s + k) AS g FROM (SELECT doc_id, ws, k, unnest(range(0, len(ws) - k + 1)) AS s FROM dw, sizes)),
hits AS (SELECT doc_id, item_id, s, gr.k FROM gr JOIN win ON gr.g = win.g AND gr.k = win.k),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM hits) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM hits) GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
