"""Collocations of two to five words from a weighted de Bruijn graph of each language.

Texts are lower-cased (A-Z only) and split into pieces and words by bytes.  A candidate phrase is
contiguous in a piece and occurs ``least`` times or more, so each two neighbouring words of it do too.

1. Words are counted by their text, pairs of neighbours by a 64-bit hash.  The places of the pairs that
   reach ``least`` are set in a table of ``PLACES`` bits, which goes to all tasks; its size is fixed.
   Pieces are cut into runs where a pair's bit is unset.  A place that is set by chance cuts less, but
   changes no count.
2. Every word that another follows in its run opens its longest gram: ``ORDER`` words, or those up to
   the end of the run.  A gram of ORDER words is an edge between the nodes of its first and its last
   ORDER - 1 words; shorter grams are the corrections for run ends.  Spark counts both by their text:
   there is one row for each place of a frequent pair, so never more rows than words.
3. What flows through a node is the sum of its out-edges and of the run ends in it.  The same sum over
   all edges that begin with a shorter phrase, and run ends, is the count of that phrase.
4. Frequent edges whose common node nothing else enters or leaves are compacted into paths, by doubling
   pointers.  All phrases of ORDER - 1 words and more within a path have its weight, so they are read
   off the paths; only branching nodes and shorter phrases keep rows of their own.
5. Candidates are cut in two at each word and scored by exact decimal arithmetic.

Memory of a task: a slice of whole pieces of about ``SLICE`` bytes, or the longest piece, the words and
pairs gathered so far, which are passed on beyond ``HELD`` or ``HELD_BYTES``, and a batch of grams.

Defined results: null texts are empty and count no word; null languages are ``und``; repeated rows count
each; other columns are not looked at; no phrases and no rows come from an empty table; a piece of any
length is counted whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fitrank.llm.batches import as_batch
from fitrank.llm.scratch import settle
from fitrank.llm.shingles import mixed

ORDER = 5
LEAST = 100
TOP = 2000
PLACES = 26  # the table of frequent words and pairs has 2^26 bits
SLICE = 1 << 19
HELD = 1_000_000  # counted words or hashes of a task
HELD_BYTES = 1 << 26  # bytes of the counted words of a task
SENT = 1 << 16  # rows of a batch
SENT_BYTES = 1 << 22  # bytes of the grams of a batch, but for the last one
PARTS = 64  # parts of a language that are ranked before it is ranked whole
DELIMITERS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"

SMALL = np.arange(256, dtype=np.uint8)
SMALL[ord("A") : ord("Z") + 1] += 32
SMALL[ord("\t")] = ord(" ")
KIND = np.zeros(256, np.uint8)  # 0 in words, 1 between words, 2 between pieces
KIND[list(BLANKS)] = 1
KIND[list(DELIMITERS)] = 2
BASE = 0x9E3779B97F4A7C15  # odd


class Powers:
    """Powers of an odd number and of its inverse modulo 2^64, as many as asked for."""

    def __init__(self):
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def grow(self, size: int):
        if size > len(self.up):
            steps = (np.full(size * 5 // 4, x, np.uint64) for x in (BASE, pow(BASE, -1, 1 << 64)))
            self.up, self.down = (np.cumprod(np.append(np.ones(1, np.uint64), step)) for step in steps)

    def hashes(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of the bytes of each word, wherever it stands."""
        self.grow(len(points))
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum((points + np.uint64(1)) * self.up[: len(points)], out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * self.down[starts])


class Words:
    """The words of a slice: text, hash with the language, and whether another follows in the piece."""

    def __init__(self, texts: list[bytes], langs: list[str], powers: Powers):
        points = SMALL[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
        kinds = KIND[points]
        edges = np.flatnonzero(np.diff(kinds == 0, prepend=False, append=False))
        starts, ends = edges[::2], edges[1::2]
        limits = np.cumsum([len(text) + 1 for text in texts])
        owners = np.searchsorted(limits, starts, side="right")
        names = {lang: i for i, lang in enumerate(dict.fromkeys(langs))}
        self.names = list(names)
        self.langs = np.array([names[lang] for lang in langs], np.int32)[owners]
        salts = np.array([int.from_bytes(hash_of(lang), "big") for lang in names], np.uint64)
        self.hashes = mixed(powers.hashes(points.astype(np.uint64), starts, ends) + salts[self.langs])
        pieces = np.searchsorted(np.flatnonzero(kinds == 2), starts)
        self.followed = np.append(pieces[1:] == pieces[:-1], False)[: len(starts)]
        # All words with one blank after each; word i begins at byte begins[i].
        kept = kinds == 0
        kept[ends] = True
        points[ends] = ord(" ")
        self.text, self.begins = points[kept], np.append(0, np.cumsum(ends - starts + 1))

    def pairs(self) -> np.ndarray:
        """A hash of each word and the next one."""
        return mixed(mixed(self.hashes) + np.append(self.hashes[1:], np.uint64(0)))

    def columns(self, first: np.ndarray, lengths: np.ndarray) -> dict[str, pa.Array]:
        """The language and text of the grams of ``lengths`` words from the words ``first`` on."""
        begins = self.begins[first]
        offsets = np.append(0, np.cumsum(self.begins[first + lengths] - 1 - begins))
        places = np.arange(offsets[-1]) + np.repeat(begins - offsets[:-1], np.diff(offsets))
        texts = (pa.py_buffer(x) for x in (offsets.astype(np.int32), self.text[places]))
        langs = pa.DictionaryArray.from_arrays(pa.array(self.langs[first]), pa.array(self.names, pa.string()))
        return {
            "lang": langs.cast(pa.string()),
            "gram": pa.Array.from_buffers(pa.string(), len(first), [None, *texts]),
        }


def hash_of(name: str) -> bytes:
    import hashlib

    return hashlib.blake2b(name.encode(), digest_size=8).digest()


def word_slices(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[Words]:
    """Words of about ``limit`` bytes at once; longer texts are cut between pieces."""
    import re

    powers = Powers()
    between = re.compile(b"[" + re.escape(DELIMITERS) + b"]")
    texts, langs, size = [], [], 0
    for batch in batches:
        column = pc.fill_null(batch.column("text"), "").cast(pa.binary())
        for text, lang in zip(column, batch.column("lang").to_pylist(), strict=True):
            text, start = text.as_py(), 0
            while start < len(text):
                cut = between.search(text, start + limit) if len(text) - start > limit else None
                end = cut.end() if cut else len(text)
                texts.append(text[start:end])
                langs.append(lang)
                size, start = size + end - start, end
                if size >= limit:
                    yield Words(texts, langs, powers)
                    texts, langs, size = [], [], 0
    if texts:
        yield Words(texts, langs, powers)


def summed(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(hashes)
    hashes, counts = hashes[order], counts[order]
    first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])[: len(hashes)])
    return hashes[first], np.add.reduceat(counts, first) if len(first) else counts


def added(tables: list[pa.Table]) -> pa.Table:
    sums = pa.concat_tables(tables).group_by(["lang", "gram"], use_threads=False).aggregate([("count", "sum")])
    return sums.rename_columns(["lang", "gram", "count"])


def fullness(tables: list[pa.Table], held: int) -> float:
    return max(sum(map(len, tables)) / held, sum(table.nbytes for table in tables) / HELD_BYTES)


def part_counts(batches: Iterator[pa.RecordBatch], limit: int, held: int) -> Iterator[pa.RecordBatch]:
    """Counts of words, of the hashes of pairs, and the number of words of each language."""
    hashes, words, totals = [], [], Counter()

    def rows(count: pa.Array, **known: pa.Array) -> pa.RecordBatch:
        kinds = {"lang": pa.string(), "word": pa.string(), "hash": pa.int64()}
        columns = {name: known[name] if name in known else pa.nulls(len(count), kind) for name, kind in kinds.items()}
        return as_batch(columns | {"count": count})

    def passed_hashes(some: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(some), SENT):
            places = slice(at, at + SENT)
            yield rows(pa.array(counts[places]), hash=pa.array(some[places].view(np.int64)))

    def passed_words(table: pa.Table) -> Iterator[pa.RecordBatch]:
        for some in table.combine_chunks().to_batches(SENT):
            yield rows(some.column("count"), lang=some.column("lang"), word=some.column("gram"))

    for some in word_slices(batches, limit):
        for lang, count in zip(some.names, np.bincount(some.langs, minlength=len(some.names)).tolist()):
            totals[lang] += count
        pairs = some.pairs()[some.followed]
        hashes.append(summed(pairs, np.ones(len(pairs), np.int64)))
        if sum(len(part[0]) for part in hashes) > held:
            hashes = [summed(*(np.concatenate(x) for x in zip(*hashes)))]
            if len(hashes[0][0]) > held // 2:
                yield from passed_hashes(*hashes.pop())
        every = np.arange(len(some.langs))
        columns = some.columns(every, np.ones_like(every))
        words.append(added([pa.table(columns | {"count": pa.array(np.ones_like(every))})]))
        if fullness(words, held) > 1:
            words = [added(words)]
            if fullness(words, held) > 0.5:
                yield from passed_words(words.pop())
    if hashes:
        yield from passed_hashes(*summed(*(np.concatenate(x) for x in zip(*hashes))))
    if words:
        yield from passed_words(added(words))
    yield rows(pa.array(list(totals.values()), pa.int64()), lang=pa.array(list(totals), pa.string()))


def frequent_places(counts: DataFrame, least: int) -> np.ndarray:
    """The bit table of hashes that are counted ``least`` times or more, one byte for each 8 bits."""
    place = F.shiftrightunsigned("hash", 64 - PLACES)
    bit = (place % 32).cast("int")
    rows = (
        counts.filter(F.col("count") >= least)
        .groupBy(F.shiftright(place, 5).cast("int").alias("cell"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)).alias("bits"))
        .toPandas()  # at most 2^(PLACES - 5) rows, whatever the input
    )
    cells = np.zeros(1 << (PLACES - 5), np.uint32)
    cells[rows["cell"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).astype(np.uint32)
    return cells


def is_frequent(hashes: np.ndarray, cells: np.ndarray) -> np.ndarray:
    place = hashes >> np.uint64(64 - PLACES)
    return (cells[place >> np.uint64(5)] >> (place & np.uint64(31)).astype(np.uint32)) & 1 == 1


def longest_grams(batches: Iterator[pa.RecordBatch], cells: np.ndarray, limit: int) -> Iterator[pa.RecordBatch]:
    """The longest gram of two words or more at each word that opens one, in batches of bounded size."""
    for words in word_slices(batches, limit):
        size = len(words.langs)
        breaks = np.flatnonzero(~(words.followed & is_frequent(words.pairs(), cells)))
        to_end = breaks[np.searchsorted(breaks, np.arange(size))] - np.arange(size) + 1
        first = np.flatnonzero(to_end > 1)
        lengths = np.minimum(to_end[first], ORDER)
        volumes = np.cumsum(words.begins[first + lengths] - words.begins[first])
        batch = np.arange(len(first)) // SENT + volumes // SENT_BYTES
        for places in np.split(np.arange(len(first)), np.flatnonzero(np.diff(batch)) + 1):
            counts = lengths[places]
            yield as_batch(words.columns(first[places], counts) | {"size": pa.array(counts.astype(np.int32))})


def narrow_texts(docs: DataFrame, text_column: str, lang_column: str) -> DataFrame:
    return docs.select(
        F.coalesce(docs[lang_column].cast("string"), F.lit("und")).alias("lang"),
        docs[text_column].cast("string").alias("text"),
    )


def edges(
    docs: DataFrame,
    least: int = LEAST,
    text_column: str = "text",
    lang_column: str = "lang",
    limit: int = SLICE,
    held: int = HELD,
) -> tuple[DataFrame, DataFrame]:
    """The counted words and longest grams (``lang, gram, size, count``) and the words of each ``lang``, ``n``."""
    texts = narrow_texts(docs, text_column, lang_column)
    counts = (
        texts.mapInArrow(
            lambda x: part_counts(x, limit, held), "lang string, word string, hash bigint, count bigint"
        )
        .repartition("word", "hash")  # counted in the tasks, so that another sum before the shuffle gains little
        .groupBy("lang", "word", "hash")
        .agg(F.sum("count").alias("count"))
    )
    is_total = F.col("word").isNull() & F.col("hash").isNull()
    counts = settle(counts.filter(is_total | (F.col("count") >= least)), "pairs")
    pairs = counts.filter(F.col("hash").isNotNull())
    shared = docs.sparkSession.sparkContext.broadcast(frequent_places(pairs, least))  # of fixed size
    grams = (
        texts.mapInArrow(lambda x: longest_grams(x, shared.value, limit), "lang string, gram string, size int")
        .groupBy("lang", "gram", "size")
        .agg(F.count("*").alias("count"))
    )
    words = counts.filter(F.col("word").isNotNull())
    words = words.select("lang", F.col("word").alias("gram"), F.lit(1).alias("size"), "count")
    totals = counts.filter(is_total).select("lang", F.col("count").alias("n"))
    return settle(words.unionByName(grams), "grams"), totals


def first_words(phrase: str | Column, count) -> Column:
    return F.substring_index(phrase, " ", count) if isinstance(count, int) else F.call_function(
        "substring_index", F.col(phrase), F.lit(" "), count
    )


def without_first(phrase: str) -> Column:
    return F.expr(f"substring({phrase}, instr({phrase}, ' ') + 1)")


def flows(grams: DataFrame, least: int) -> DataFrame:
    """``lang, phrase, size, count`` of all phrases of 1 to ORDER words counted ``least`` or more."""
    sizes = F.sequence(F.least("size", F.lit(2)), F.least("size", F.lit(ORDER - 1)))  # words are counted whole
    shorter = (
        grams.select("lang", "gram", "count", F.explode(sizes).alias("size"))
        .groupBy("lang", first_words("gram", F.col("size")).alias("phrase"), "size")
        .agg(F.sum("count").alias("count"))
    )
    longest = grams.filter(F.col("size") == ORDER).select("lang", F.col("gram").alias("phrase"), "size", "count")
    return shorter.unionByName(longest).filter(F.col("count") >= least)


def compacted(frequent: DataFrame) -> DataFrame:
    """``lang, path, count``: frequent edges, joined where nothing else passes their common node."""
    edge = frequent.filter(F.col("size") == ORDER).select("lang", F.col("phrase").alias("edge"), "count")
    node = frequent.filter(F.col("size") == ORDER - 1).select("lang", F.col("phrase").alias("node"), "count")
    into = edge.select("lang", "count", F.col("edge").alias("before"), without_first("edge").alias("node"))
    out = edge.select("lang", "count", "edge", first_words("edge", ORDER - 1).alias("node"))
    # An edge that carries all that flows through a node is the only one on its side.
    same = ["lang", "node", "count"]
    links = into.join(node, same).join(out, same).filter(F.col("before") != F.col("edge"))
    pointers = settle(
        edge.join(links.select("lang", "edge", "before"), ["lang", "edge"], "left").select(
            "lang",
            "edge",
            "count",
            F.coalesce("before", "edge").alias("head"),
            F.col("before").isNotNull().cast("bigint").alias("far"),
        ),
        "paths",
    )
    while True:
        above = pointers.select("lang", F.col("edge").alias("head"), F.col("head").alias("top"), F.col("far").alias("more"))
        stepped = settle(
            pointers.join(above, ["lang", "head"]).select(
                "lang", "edge", "count", F.col("top").alias("head"), (F.col("far") + F.col("more")).alias("far"), "more"
            ),
            "paths",
        )
        pointers = stepped.drop("more")
        if not stepped.filter(F.col("more") > 0).limit(1).count():
            break
    last = F.substring_index("edge", " ", -1)
    # A path is at most as long as a run of words of one piece.
    rest = F.array_sort(F.collect_list(F.when(F.col("far") > 0, F.struct("far", last.alias("word")))))
    return pointers.groupBy("lang", "head", "count").agg(rest.alias("rest")).select(
        "lang", F.array_join(F.concat(F.array("head"), F.col("rest")["word"]), " ").alias("path"), "count"
    )


def phrase_counts(grams: DataFrame, least: int = LEAST) -> DataFrame:
    """``lang, phrase, size, count``: read off the compacted paths, branching nodes, shorter phrases."""
    frequent = settle(flows(grams, least), "flows")
    paths = settle(compacted(frequent), "compacted")
    words = paths.select("lang", "count", F.split("path", " ").alias("words"))

    def windows(size: int, inner: int) -> DataFrame:
        """Phrases of a size within paths, ``inner`` words away from the ends."""
        spans = F.transform(
            F.sequence(F.lit(1 + inner), F.size("words") - size + 1 - inner),
            lambda i: F.array_join(F.slice("words", i, size), " "),
        )
        long = words.filter(F.size("words") >= size + 2 * inner)
        return long.select("lang", F.explode(spans).alias("phrase"), F.lit(size).alias("size"), "count")

    inside = windows(ORDER - 1, 1)
    others = frequent.filter(F.col("size") == ORDER - 1).join(inside.select("lang", "phrase"), ["lang", "phrase"], "left_anti")
    return (
        windows(ORDER, 0).unionByName(inside).unionByName(others)
        .unionByName(frequent.filter(F.col("size") < ORDER - 1))
    )


def scored(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """``lang, phrase, size, a, l, r, n, score`` by the lowest-scoring cut of each phrase."""
    known = counts.select("lang", F.col("phrase").alias("part"), F.col("count"))
    cuts = counts.filter(F.col("size") > 1).select(
        "lang", "phrase", "size", F.col("count").alias("a"),
        F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"),
    )
    halves = cuts.withColumn("part", first_words("phrase", F.col("k")))
    halves = halves.join(known.withColumnRenamed("count", "l"), ["lang", "part"]).withColumn(
        "part", first_words("phrase", F.col("k") - F.col("size"))
    )
    halves = halves.join(known.withColumnRenamed("count", "r"), ["lang", "part"]).join(totals, "lang")
    wide = lambda name: F.col(name).cast("decimal(19,0)")
    score = F.call_function("div", wide("a") * wide("n") * F.lit(1000).cast("decimal(4,0)"), wide("l") * wide("r"))
    return (
        halves.withColumn("score", score)
        .groupBy("lang", "phrase", "size", "a", "n")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
        .select("lang", "phrase", "size", "a", "best.l", "best.r", "n", "best.score")
    )


def within_longer(counts: DataFrame) -> DataFrame:
    """``lang, phrase, count`` of candidates inside a longer candidate as frequent as they are."""
    words = F.split("phrase", " ")
    spans = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.col("size") - 1),
            lambda size: F.transform(
                F.sequence(F.lit(1), F.col("size") - size + 1), lambda i: F.array_join(F.slice(words, i, size), " ")
            ),
        )
    )
    return counts.filter(F.col("size") > 2).select("lang", "count", F.explode(spans).alias("phrase")).distinct()


def mine(
    docs: DataFrame,
    least: int = LEAST,
    top: int = TOP,
    text_column: str = "text",
    lang_column: str = "lang",
    limit: int = SLICE,
    held: int = HELD,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of the best ``top`` phrases of each language."""
    grams, totals = edges(docs, least, text_column, lang_column, limit, held)
    counts = settle(phrase_counts(grams, least), "phrases")
    kept = scored(counts, totals).join(
        within_longer(counts).withColumnRenamed("count", "a"), ["lang", "phrase", "a"], "left_anti"
    )
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    # Ranked in parts first, so that no task sorts a whole language.
    some = kept.withColumn("part", part).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))
    )
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    best = some.filter(F.col("rank") <= top).withColumn("rank", rank.cast("bigint"))
    return best.filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = f"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS piece, piece AS content FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
words AS (
  SELECT lang, list_filter(string_split_regex(content, '[\\x20\\x09]+'), lambda w: w <> '') AS w FROM pieces),
spots AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words WHERE len(w) > 0),
total AS (SELECT lang, count(*) AS n FROM spots GROUP BY lang),
spans AS (SELECT lang, w, i, unnest(range(1, least({ORDER}, len(w) - i + 1) + 1)) AS size FROM spots),
f AS (
  SELECT lang, array_to_string(list_slice(w, i, i + size - 1), ' ') AS phrase, size, count(*) AS c
  FROM spans GROUP BY ALL HAVING count(*) >= {LEAST}),
cand AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
cuts AS (
  SELECT lang, phrase, size, c AS a, k, array_to_string(list_slice(w, 1, k), ' ') AS p,
         array_to_string(list_slice(w, k + 1, size), ' ') AS q
  FROM (SELECT *, unnest(range(1, size)) AS k FROM cand)),
scored AS (
  SELECT cuts.lang, cuts.phrase, a, x.c AS l, y.c AS r, n,
         ((1000::HUGEINT * a * n) // (x.c::HUGEINT * y.c))::BIGINT AS score, k
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = p
            JOIN f y ON y.lang = cuts.lang AND y.phrase = q JOIN total t ON t.lang = cuts.lang),
lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (
  SELECT * FROM lowest s WHERE NOT EXISTS (
    SELECT 1 FROM cand g WHERE g.lang = s.lang AND 100 * g.c >= 100 * s.a AND length(g.phrase) > length(s.phrase)
      AND contains(' ' || g.phrase || ' ', ' ' || s.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
       phrase, a, l, r, n, score
FROM kept QUALIFY rank <= {TOP}
"""
