"""Which texts hold which names: one pass of an automaton, or names dealt by their rarest long gram."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.lineage import cut, slices
from strataloom.operators.joins import join_split

#: Most bytes of names, in UTF-8, of which every executor builds one automaton.
AUTOMATON_BYTES = 4 << 20
#: Lengths of grams; a name is dealt by a gram of the largest length that it holds, which is more than half of it up to the last.
SIZES = (1, 2, 4, 8, 16, 32, 64)
#: Bits by which a text's grams are sifted, two for each gram of a name, and bits sent as one row.
BITS = 1 << 27
_BLOCK = 1 << 18

_FOUND = "key {kind}, name string, at int"


def _folded(column: Column) -> Column:
    return F.arrow_udf(lambda texts: pa.array([None if t is None else t.casefold() for t in texts.to_pylist()], pa.string()), "string")(column)


def _scan(names):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for name in names.value:
            automaton.add_word(name, (name, len(name)))
        if names.value:
            automaton.make_automaton()
        for batch in batches:
            rows, found, places = [], [], []
            for row, text in enumerate(batch.column(1).to_pylist() if names.value else []):
                first: dict[str, int] = {}
                for end, (name, length) in automaton.iter((text or "").casefold()):
                    first.setdefault(name, end - length + 1)
                rows += [row] * len(first)
                found += first
                places += first.values()
            yield pa.record_batch([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(found, pa.string()), pa.array(places, pa.int32())], ["key", "name", "at"])

    return run


def _grams(text: str, sizes: Sequence[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(size, hashes of all runs of that many characters), each made of two runs of half the size."""
    hashes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    for size in SIZES:
        half = size // 2
        n = len(hashes) - half
        if n < 1:
            return
        hashes = (hashes[:n] * np.uint64(0x9E3779B97F4A7C15) ^ (hashes[half:] if half else np.uint64(0))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(size)
        hashes ^= hashes >> np.uint64(31)
        if size in sizes:
            yield size, hashes


def _probes(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (grams % np.uint64(BITS)).astype(np.int64), ((grams >> np.uint64(32)) % np.uint64(BITS)).astype(np.int64)


def _name_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first, the middle and the last gram of each name."""
    for batch in batches:
        names, sizes, grams = [], [], []
        for row, name in enumerate(batch.column(0).to_pylist()):
            size, hashes = list(_grams(name, SIZES))[-1]
            own = {int(hashes[i].astype(np.int64)) for i in (0, len(hashes) // 2, len(hashes) - 1)}
            names += [row] * len(own)
            sizes += [size] * len(own)
            grams += own
        yield pa.record_batch([batch.column(0).take(pa.array(names, pa.int64())), pa.array(sizes, pa.int32()), pa.array(grams, pa.int64())], ["name", "size", "gram"])


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The places of bits, by the block of the bit."""
    for batch in batches:
        places = np.unique(np.concatenate(_probes(batch.column(0).to_numpy().view(np.uint64))))
        yield pa.record_batch([pa.array(places // _BLOCK), pa.array((places % _BLOCK).astype(np.int32))], ["block", "place"])


def _packed(rows: pa.Table) -> pa.Table:
    bits = np.zeros(_BLOCK, bool)
    bits[rows.column("place").to_numpy()] = True
    return pa.table({"block": rows.column("block")[:1], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})


def _sift(bits, sizes):
    def held(grams: np.ndarray) -> np.ndarray:
        for places in range(2):
            at = _probes(grams)[places]
            grams = grams[(bits.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0]
        return grams

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                rows, grams = [], []
                for row, text in enumerate(batch.column(1).to_pylist()):
                    own = np.unique(np.concatenate([np.zeros(0, np.uint64), *(held(g) for _, g in _grams((text or "").casefold(), sizes))]))
                    rows.append(np.full(len(own), row))
                    grams.append(own.view(np.int64))
                rows, grams = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (rows, grams))
                yield pa.record_batch([batch.column(0).take(pa.array(rows)), pa.array(grams)], ["key", "gram"])

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, found, places = [], [], []
        for row, (text, names) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            folded = text.casefold()
            for name in names:
                at = folded.find(name)
                if at >= 0:
                    rows.append(row)
                    found.append(name)
                    places.append(at)
        yield pa.record_batch([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(found, pa.string()), pa.array(places, pa.int32())], ["key", "name", "at"])


def _by_grams(texts: DataFrame, names: DataFrame, schema: str, kind: str) -> DataFrame:
    spark = texts.sparkSession
    grams = cut(names.mapInArrow(_name_grams, "name string, size int, gram long"))
    shared = grams.groupBy("gram").agg(F.count("*").alias("n"))
    dealt = cut(grams.join(shared, "gram").groupBy("name").agg(F.min(F.struct("n", "gram", "size")).alias("own")).select("name", "own.gram", "own.size"))
    sizes = [r["size"] for r in dealt.select("size").distinct().collect()]
    places = dealt.select("gram").mapInArrow(_bits, "block long, place int")
    bits = np.zeros(BITS // 8, np.uint8)
    for row in places.groupBy("block").applyInArrow(_packed, "block long, bits binary").toLocalIterator():  # 16 MB, whatever the input
        bits[row["block"] * _BLOCK // 8 :][: _BLOCK // 8] = np.frombuffer(row["bits"], np.uint8)
    hits = texts.mapInArrow(_sift(spark.sparkContext.broadcast(bits), sizes), f"key {kind}, gram long")
    candidates = join_split(hits, dealt.select("gram", "name"), "gram", 128).where("name is not null")
    lists = candidates.groupBy("key").agg(F.collect_set("name").alias("names"))
    return texts.join(lists, "key").select("key", "text", "names").mapInArrow(_verify, schema)


def name_matches(texts: DataFrame, names: DataFrame, key: str = "doc_id", text: str = "content", name: str = "name") -> DataFrame:
    """(key, name, at): each name that a text holds anywhere, case folded, and where it first begins in the folded text.

    ``names`` may repeat; null and empty ones are none.  ``key`` has to tell the texts apart.  If all
    names, which are counted, are small enough, each task goes through its texts once with an automaton
    of all of them.  Else a name is dealt by its first, middle or last gram, whichever the fewest names share; texts
    meet the names whose grams they have, and are searched for these alone.
    """
    kind = texts.schema[key].dataType.simpleString()
    schema = _FOUND.format(kind=kind)
    source = texts.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    distinct = cut(names.select(_folded(F.col(name)).alias("name")).where("name <> ''").distinct())
    size = distinct.agg(F.coalesce(F.sum(F.octet_length("name")), F.lit(0))).first()[0]
    if size <= AUTOMATON_BYTES:
        listed = texts.sparkSession.sparkContext.broadcast([r["name"] for r in distinct.collect()])
        found = source.mapInArrow(_scan(listed), schema)
    else:
        found = _by_grams(source, distinct, schema, kind)
    return found.withColumnRenamed("key", key)


def entity_mentions(texts: DataFrame, entities: DataFrame, key: str = "doc_id", text: str = "content") -> DataFrame:
    """(key, entity_id, name, at): texts that hold any of an entity's ``candidates``, and the least of those they hold.

    ``entities`` are (entity_id, candidates), an array of spellings.
    """
    spelled = entities.select("entity_id", F.explode("candidates").alias("spelling")).select("entity_id", _folded(F.trim("spelling")).alias("name")).where("name <> ''").distinct()
    spelled = cut(spelled)
    found = join_split(name_matches(texts, spelled, key, text), spelled, "name")
    return found.groupBy(key, "entity_id").agg(F.min(F.struct("name", "at")).alias("first")).select(key, "entity_id", "first.name", "first.at")


#: Kinds of relations by the words that tell of them, in the order in which they are tried.
RELATIONS = {
    "supports": r"\bsupports?\b", "returns": r"\breturns?\b", "requires": r"\brequires?\b", "uses": r"\buses?\b", "provides": r"\bprovides?\b", "turns_into": r"\bturns?\b.+\binto\b", "documents": r"\bdocuments?|documented\b", "contacts": r"\bcontacts?\b",
}
SENTENCE_CHARS = 420


def sentence_relations(texts: DataFrame, entities: DataFrame, key: str = "doc_id", text: str = "content") -> DataFrame:
    """(key, sentence, left_id, right_id, relation): pairs of entities that a sentence of a text holds both, each sentence once.

    Sentences end at a stop, question or exclamation mark before white space, and count up to ``SENTENCE_CHARS``, so pairs are
    bounded by a sentence, not by a text.  A sentence's pairs are made of its own sorted entities.
    """
    folded = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", " "))
    cut_off = F.transform(F.split(folded, r"(?<=[.!?])\s+"), lambda s: F.left(F.trim(s), F.lit(SENTENCE_CHARS)))
    rows = texts.select(F.col(key).alias("_key"), F.posexplode(cut_off).alias("sentence", "said")).where("said <> ''")
    rows = rows.withColumn("_at", F.struct("_key", "sentence"))
    found = entity_mentions(rows.select(F.to_json("_at").alias("_at"), "said"), entities, "_at", "said")
    lists = found.groupBy("_at").agg(F.array_sort(F.collect_set("entity_id")).alias("ids")).where("size(ids) > 1")
    pairs = F.flatten(F.transform("ids", lambda a, i: F.transform(F.slice("ids", i + 2, F.size("ids")), lambda b: F.struct(a.alias("left_id"), b.alias("right_id")))))
    kind = F.lit("related_in_sentence")
    for name, pattern in reversed(RELATIONS.items()):
        kind = F.when(F.col("said").rlike(f"(?i){pattern}"), name).otherwise(kind)
    joined = rows.withColumn("_at", F.to_json("_at")).join(lists, "_at")
    return joined.select(F.col("_key").alias(key), "sentence", kind.alias("relation"), F.explode(pairs).alias("p")).select(key, "sentence", "p.left_id", "p.right_id", "relation")
