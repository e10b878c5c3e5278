"""Test items inside long documents: containment by MinHash, checked on shingles.

An item's set is its distinct five-word shingles, q of them. A document holds the
item if it has at least 0.8 q of them. Items are partitioned by size (powers of
two); the signature of an item is its smallest shingle hashes, and the partition
sets how many: so many that a document cannot miss all of them and still hold the
item (any q - ceil(0.8 q) + 1 of q shingles include a shared one). Each document's
shingle hashes are looked up among these minima, which gives the candidates, with no
chance of a miss and no cap. Candidates are decided on the shingles themselves.

A signature of fixed length over whole documents would not do: a 30-shingle item in a
document of 20,000 has a Jaccard similarity of 0.0015 and needs thousands of minima.

An item of fewer than five words is one shingle, all of its words, and so is a text; so such an
item is found where it is the whole text, and not inside longer ones: phrases that short are
part of clean texts.

Null texts are empty: they hold nothing and are held by nothing. Rows with the same
id are decided each for itself and a pair is given once. Null ids are ids like others. Empty
tables of documents or items give an empty one. Long texts are rows like others; their shingles
are exploded, never gathered. Columns besides ids and texts are not read, and ``clean`` keeps
them, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubespark.llm.steps import Steps, small
from cubespark.llm.words import hashed, shingles, spelled

SHARE = (4, 5)  # 0.8 as a fraction


def _needed(q):
    """The least number of an item's shingles in a document that holds it."""
    return F.ceil(q * SHARE[0] / SHARE[1]).cast("int")


def item_minima(items: DataFrame) -> DataFrame:
    """(item, hash): the smallest hashes of each item, as many as its size partition asks."""
    sets = items.select("item", F.array_distinct(shingles(F.col("item_text"), hashed)).alias("set"))
    q = F.size("set")
    largest = F.pow(F.lit(2), F.floor(F.log2(q)) + 1).cast("int") - 1
    taken = largest - _needed(largest) + 1
    return (
        sets.where(q > 0)
        .select("item", F.explode(F.slice(F.array_sort("set"), 1, taken)).alias("hash"))
    )


def contained(docs: DataFrame, items: DataFrame, doc_id="doc_id", text="text", item_id="item_id", item_text="text") -> DataFrame:
    """(doc, item, shingles of the item, how many of them the document has)."""
    steps = Steps(docs.sparkSession)
    docs = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    items = items.select(F.col(item_id).alias("item"), F.col(item_text).alias("item_text")).distinct()
    minima = steps.kept(item_minima(items), "item-minima")
    # the outer form: the inner one would compute the shingles once more, to drop empty lists
    found = docs.select("doc", F.explode_outer(shingles(F.col("text"), hashed)).alias("hash"))
    pairs = found.join(small(minima, minima.count()), "hash").select("doc", "item").distinct()
    pairs = steps.kept(pairs, "candidates")
    n_pairs = pairs.count()
    spelled_items = items.select("item", F.array_distinct(shingles(F.col("item_text"), spelled)).alias("wanted"))
    wanted = pairs.join(spelled_items, pairs["item"].eqNullSafe(spelled_items["item"])).select(
        "doc", pairs["item"].alias("item"), "wanted"
    )
    ids = pairs.select(F.col("doc").alias("d")).distinct()
    held = docs.join(small(ids, n_pairs), F.col("doc").eqNullSafe(F.col("d")), "left_semi").withColumnRenamed("doc", "d")
    sets = held.select("d", F.array_distinct(shingles(F.col("text"), spelled)).alias("set"))
    decided = (
        sets.join(wanted, F.col("d").eqNullSafe(F.col("doc")))
        .select("doc", "item", F.size("wanted").alias("q"), F.size(F.array_intersect("wanted", "set")).alias("shared"))
        .where(F.col("shared") >= _needed(F.col("q")))
    )
    return (
        decided.groupBy("doc", "item")
        .agg(F.max("q").alias("n_shingles"), F.max("shared").alias("n_shared"))
        .withColumnsRenamed({"doc": doc_id, "item": item_id})
    )


def clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that hold no item, with all their columns; each row is judged by its own text."""
    # rows that share an id, or have none, are told apart by their text
    name = F.struct(F.col(f"`{doc_id}`").alias("id"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("body"))
    rows = docs.select(name.alias("name"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    named = rows.select("name", F.col("row")[text].alias("text"))
    held = contained(named, items, doc_id="name").select(F.col("name").alias("held")).distinct()
    held = Steps(docs.sparkSession).kept(held, "held")
    return rows.join(small(held, held.count()), F.col("name") == F.col("held"), "left_anti").select("row.*")


ORACLE_SQL = r"""
with item_words as (
  select item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda w: w <> '') as w from benchmark),
doc_words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda w: w <> '') as w from documents),
item_set as (
  select distinct item_id, unnest(case when len(w) >= 5
    then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from item_words),
doc_set as (
  select distinct doc_id, unnest(case when len(w) >= 5
    then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from doc_words),
sizes as (select item_id, count(*)::int as n_shingles from item_set group by item_id)
select doc_id, item_id, n_shingles, count(*)::int as n_shared
from doc_set join item_set using (s) join sizes using (item_id)
group by doc_id, item_id, n_shingles having 5 * count(*) >= 4 * n_shingles
"""
