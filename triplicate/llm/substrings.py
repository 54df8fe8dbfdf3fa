"""Removal of passages that also stand in an earlier document, by parsing documents against indexed reference blocks.

Documents are dealt into blocks by a hash of their doc_id; every block is a reference, indexed by phrases. In a window of
``WINDOW`` words the phrase of least hash is its anchor, which depends on the window's words alone, so equal windows have
one anchor wherever they stand. A block tells the others its anchors; where another block has the same, the stretch of
words around it goes to the anchor's task. There documents are factored greedily, in the order of doc_id, against all
stretches before: the longest run of words that an earlier stretch has, word by word, is a factor; the next lookup is of
the first window that the factor does not hold, so windows across a factor's end are checked like any other. Factors of
``WINDOW`` words and more make up the duplicate spans.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from xxhash import xxh64_intdigest

from triplicate.llm.common import fresh, mix, plainly_named, prepare, table, texts, words_of

WINDOW = 13
#: Words of the phrases of which one is a window's anchor.
PHRASE = 5
#: Bytes of text in a reference block, about; a longer document is a block of its own.
BLOCK_BYTES = 2 << 20
#: Stretches with one anchor that one task factors, about; beyond it their windows are dealt by hash as well.
GROUP = 4096
_PHRASE_ROWS = "phrase long, block long, n long, unsure boolean"
#: A stretch of words, or, without ``words``, a run of ``n`` windows that its own block has settled.
_STRETCH = "anchor long, salt int, id long, digest long, start int, n int, words binary"
_SPAN = "id long, digest long, start int, n int"


def _rolling(words: np.ndarray, size: int, seed: int) -> np.ndarray:
    """A hash of each ``size`` words in a row, from each word on; the last ones are of no use."""
    out = np.zeros(len(words), np.uint64)
    for k in range(size):
        out[: len(words) - k] += mix(words[k:] + np.uint64(seed + k))
    return mix(out)


def _numbered(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word, the same for the same bytes alone, and each word's hash."""
    size = end - begin
    offsets = np.concatenate(([0], np.cumsum(size)))
    letters = raw[np.repeat(begin - offsets[:-1], size) + np.arange(offsets[-1])]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
    hashes = np.array([xxh64_intdigest(w) for w in words.dictionary.to_pylist()], np.uint64)
    place = words.indices.to_numpy().astype(np.int64)
    return place, hashes[place] if len(place) else np.zeros(0, np.uint64)


class _Block:
    """The documents of a block by doc_id, with their windows, anchors and what an earlier document of the block settles."""

    def __init__(self, docs: pa.Table, id_: str, digest: str, text: str) -> None:
        docs = docs.select([id_, digest, text]).sort_by([(id_, "ascending"), (digest, "ascending")]).combine_chunks()
        self.id, self.digest = docs.column(id_).to_numpy(), docs.column(digest).to_numpy()
        column = docs.column(text).fill_null("")
        raw, self.begin, self.end, first = words_of(column.chunk(0) if column.num_chunks else pa.array([], pa.string()))
        self.raw = raw.tobytes()
        counts = np.diff(first)
        place, hashes = _numbered(raw, self.begin, self.end)
        self.row = np.repeat(np.arange(len(counts)), counts)
        self.at = np.arange(len(place)) - np.repeat(np.cumsum(counts) - counts, counts)  # the word's place in its document
        self.starts = starts = np.flatnonzero(self.at + WINDOW <= np.repeat(counts, counts))
        self.window = _rolling(hashes, WINDOW, 1)[starts]
        phrase = _rolling(hashes, PHRASE, 1 << 32)
        self.anchor, self.where = phrase[starts], starts.copy()
        for k in range(1, WINDOW - PHRASE + 1):
            other = phrase[starts + k]
            smaller = other < self.anchor
            self.anchor = np.where(smaller, other, self.anchor)
            self.where[smaller] = starts[smaller] + k
        order = np.argsort(self.window, kind="stable")
        ordered = self.window[order]
        new = np.concatenate(([True], ordered[1:] != ordered[:-1]))[: len(order)]
        earliest = np.empty(len(order), np.int64)
        earliest[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
        same = np.ones(len(starts), bool)
        for k in range(WINDOW):  # words, not hashes, decide
            same &= place[starts + k] == place[starts[earliest] + k]
        before = self.id[self.row[starts[earliest]]] < self.id[self.row[starts]]
        self.settled, self.unsure = before & same, ~same

    def runs(self, these: np.ndarray, by_anchor: bool) -> tuple[np.ndarray, np.ndarray]:
        """Runs of consecutive windows of one document (and one anchor's place): the first's index in ``these``, and how many."""
        s, w = self.starts[these], self.where[these]
        new = (s[1:] != s[:-1] + 1) | (self.row[s[1:]] != self.row[s[:-1]]) | ((w[1:] != w[:-1]) & by_anchor)
        heads = np.flatnonzero(np.concatenate(([True], new)))[: len(these)]
        return heads, np.diff(np.concatenate((heads, [len(these)])))


def _phrases(names: tuple[str, str, str], block_name: str):
    """The anchors that a block does not settle itself, each with its number of stretches."""

    def run(docs: pa.Table) -> pa.Table:
        block = _Block(docs, *names)
        these = np.flatnonzero(~block.settled)
        heads, _ = block.runs(these, True)
        phrase, n = np.unique(block.anchor[these[heads]], return_counts=True)
        unsure = np.isin(phrase, block.anchor[block.unsure])
        of = np.full(len(phrase), docs.column(block_name)[0].as_py(), np.int64)
        return pa.table({"phrase": phrase.view(np.int64), "block": of, "n": n, "unsure": unsure})

    return run


def _stretches(names: tuple[str, str, str]):
    """What a block settles, and the stretches around anchors that other blocks have too."""
    schema = _schema(_STRETCH)
    fields = schema.names

    def run(docs: pa.Table, shared: pa.Table) -> pa.Table:
        block = _Block(docs, *names)
        out: list[list] = [[] for _ in fields]

        def put(these: np.ndarray, anchor: np.ndarray, salt: np.ndarray, heads: np.ndarray, n: np.ndarray, whole: bool) -> None:
            first = block.starts[these[heads]]
            of, last = block.row[first], first + n + WINDOW - 2
            spans = zip(block.begin[first].tolist(), block.end[last].tolist(), strict=True)
            told = [block.raw[a:b] for a, b in spans] if whole else [None] * len(first)
            for column, values in zip(out, (anchor.view(np.int64), salt, block.id[of], block.digest[of], block.at[first], n, told), strict=True):
                column.append(values)

        done = np.flatnonzero(block.settled)
        heads, n = block.runs(done, False)
        put(done, mix(block.id[block.row[block.starts[done[heads]]]].view(np.uint64)), np.zeros(len(heads), np.int64), heads, n, False)
        phrase = shared.column("phrase").to_numpy().view(np.uint64)
        order = np.argsort(phrase)
        phrase, tasks = phrase[order], shared.column("tasks").to_numpy()[order]
        if len(phrase):
            at = np.minimum(np.searchsorted(phrase, block.anchor), len(phrase) - 1)
            open_ = ~block.settled & (phrase[at] == block.anchor)
            these = np.flatnonzero(open_ & (tasks[at] == 1))
            heads, n = block.runs(these, True)
            put(these, block.anchor[these[heads]], np.zeros(len(heads), np.int64), heads, n, True)
            these = np.flatnonzero(open_ & (tasks[at] > 1))  # windows of frequent anchors go one by one
            each = np.arange(len(these))
            salt = (block.window[these] % tasks[at[these]].astype(np.uint64)).astype(np.int64)
            put(these, block.anchor[these], salt, each, np.ones(len(these), np.int64), True)
        arrays = [pa.array(np.concatenate(parts), f.type) for parts, f in zip(out[:-1], schema, strict=False)]
        return pa.table([*arrays, pa.array([w for part in out[-1] for w in part], pa.binary())], schema=schema)

    return run


def _schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(ddl))


def factors(stretch: list[bytes], id_: int, index: dict[bytes, tuple[list[bytes], int, int]]) -> list[tuple[int, int]]:
    """Greedy factors of a stretch, as (first window, number of windows), against the stretches of smaller ids in ``index``.

    Windows that no stretch has yet are indexed. Stretches come by id; of one id none is earlier than another.
    """
    out, i = [], 0
    while i + WINDOW <= len(stretch):
        hit = index.setdefault(b" ".join(stretch[i : i + WINDOW]), (stretch, i, id_))
        ref, at, of = hit
        if of == id_:
            i += 1
            continue
        n = WINDOW
        while i + n < len(stretch) and at + n < len(ref) and stretch[i + n] == ref[at + n]:
            n += 1
        out.append((i, n - WINDOW + 1))
        i += n - WINDOW + 1
    return out


_FOUND = pa.schema([("id", pa.int64()), ("digest", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of stretches that come by anchor, salt and id; only one anchor's index is held."""
    held, index = None, {}
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for anchor, salt, id_, digest, start, n, words in zip(*(batch.column(c).to_pylist() for c in batch.schema.names), strict=True):
            if words is None:
                spans = [(0, n)]
            else:
                if (anchor, salt) != held:
                    held, index = (anchor, salt), {}
                spans = factors(words.split(), id_, index)
            for i, k in spans:
                for column, value in zip(out, (id_, digest, start + i, k), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_pydict(dict(zip(_FOUND.names, out, strict=True)), schema=_FOUND)


def _tagged(docs: DataFrame) -> tuple[DataFrame, tuple[str, str, str], str, int]:
    """With an id that is never null, a digest that tells rows of one doc_id apart, and a block; their names; how many blocks."""
    id_, digest, block = (fresh(docs, name) for name in ("id", "digest", "block"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    of_row = {
        id_: F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)),
        digest: F.xxhash64(F.coalesce(F.col("text"), F.lit(""))),
        block: F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(blocks)),
    }
    return docs.withColumns(of_row), (id_, digest, "text"), block, blocks


def _spans(tagged: DataFrame, names: tuple[str, str, str], block: str, blocks: int) -> DataFrame:
    """(id, digest, start, n, block): runs of windows that a document of smaller id holds."""
    of_block = tagged.groupBy(block)
    phrases = of_block.applyInArrow(_phrases(names, block), _PHRASE_ROWS)
    everywhere = Window.partitionBy("phrase")
    met = phrases.withColumns({"blocks": F.count("*").over(everywhere), "total": F.sum("n").over(everywhere)})
    shared = met.where("blocks > 1 or unsure").select("block", "phrase", F.ceil(F.col("total") / GROUP).alias("tasks"))
    stretches = of_block.cogroup(shared.groupBy("block")).applyInArrow(_stretches(names), _STRETCH)
    n = int(tagged.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stretches.repartition(n, "anchor", "salt").sortWithinPartitions("anchor", "salt", "id")
    found = dealt.mapInArrow(_parse, StructType.fromDDL(_SPAN))
    # The block is a function of doc_id, which a null one's id stands for.
    hashed = F.when(F.col("id") == (1 << 63) - 1, F.xxhash64(F.lit(None).cast("long"))).otherwise(F.xxhash64("id"))
    return found.withColumn("block", F.pmod(hashed, F.lit(blocks)))


def _covered(docs: pa.Table, spans: pa.Table, names: tuple[str, str, str]) -> Iterator[tuple[str | None, list[bytes], np.ndarray | None]]:
    """Each row's text, its words and which of them lie in a matched window (None: no word)."""
    of: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for id_, digest, start, n in zip(*(spans.column(c).to_pylist() for c in ("id", "digest", "start", "n")), strict=True):
        of.setdefault((id_, digest), []).append((start, n))
    for id_, digest, text in zip(*(docs.column(c).to_pylist() for c in names), strict=True):
        words = (text or "").encode().split()
        if not (found := of.get((id_, digest))):
            yield text, words, None
            continue
        edges = np.zeros(len(words) + 1, np.int64)
        for start, n in found:
            edges[start] += 1
            edges[min(start + n + WINDOW - 1, len(words))] -= 1
        yield text, words, np.cumsum(edges[:-1]) > 0


def _counts(names: tuple[str, str, str]):
    schema = _schema(_COUNTS)

    def run(docs: pa.Table, spans: pa.Table) -> pa.Table:
        total, gone, digests = [], [], []
        for _, words, covered in _covered(docs, spans, names):
            total.append(len(words))
            gone.append(0 if covered is None else int(covered.sum()))
            kept = words if covered is None else [words[i] for i in np.flatnonzero(~covered).tolist()]
            digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        columns = {"doc_id": docs.column("doc_id"), "n_words": total, "n_removed": gone, "kept_sha256": digests}
        return pa.table(columns, schema=schema)

    return run


_COUNTS = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _cut(text: str, covered: np.ndarray) -> str:
    """What is left of a text; between kept stretches stands what stood before the later one."""
    raw, begin, end, _ = words_of(pa.array([text], pa.string()))
    edges = np.flatnonzero(np.diff(np.concatenate(([True], covered, [True]))))
    raw = raw.tobytes()
    parts: list[bytes] = []
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        parts.append(raw[(end[a - 1] if parts else begin[a]) : end[b - 1]])
    return b"".join(parts).decode()


def _kept_text(names: tuple[str, str, str], columns: list[str]):
    def run(docs: pa.Table, spans: pa.Table) -> pa.Table:
        out = [text if covered is None else _cut(text, covered) for text, _, covered in _covered(docs, spans, names)]
        at = docs.schema.get_field_index("text")
        return docs.set_column(at, docs.schema.field(at), pa.array(out, docs.schema.field(at).type)).select(columns)

    return run


def count_kept(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row: how much of it an earlier document holds.

    Words are parted by ASCII white space and compared as they stand. Null, empty and short texts lose nothing; of rows
    with equal doc_id none is earlier than the other, and a null doc_id comes after all; an empty table gives no rows;
    further columns are not read. Texts are shuffled once, by block; besides them only hashes of anchors and the
    stretches around those that two blocks share.
    """
    prepare(docs.sparkSession)
    tagged, names, block, blocks = _tagged(texts(docs))
    spans = _spans(tagged, names, block, blocks)
    return tagged.groupBy(block).cogroup(spans.groupBy("block")).applyInArrow(_counts(names), _COUNTS)


def remove_duplicates(docs: DataFrame) -> DataFrame:
    """The same rows and columns, with the words of earlier documents' passages cut out of text; null stays null.

    Other cases are as in :func:`count_kept`; columns may have any names and types.
    """
    prepare(docs.sparkSession)
    plain = plainly_named(docs)
    tagged, names, block, blocks = _tagged(plain)
    spans = _spans(tagged, names, block, blocks)
    return tagged.groupBy(block).cogroup(spans.groupBy("block")).applyInArrow(_kept_text(names, plain.columns), plain.schema).toDF(*docs.columns)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document, and those in windows of 13 that also start in an earlier document."""
    return count_kept(table(spark, sf_dir, "documents"))
