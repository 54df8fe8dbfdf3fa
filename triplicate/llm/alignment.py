"""Alignment of two tokenizers over the same texts: cut points that both share, links of overlapping tokens, counts of links."""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triplicate.llm.common import TwoGenerations, map_batches, materialize, prepare, table, texts
from triplicate.llm.tokens import ByteEncoder, byte_letters, vocabulary

#: Longer chunks are encoded anew each time rather than kept, of which each worker keeps so many.
_LONGEST_KEPT, _KEPT = 64, 250_000
#: Fewer links than this are broadcast: those that more than one in so many of all (row, link) pairs have.
FREQUENT = 1 << 17


class Letters(ByteEncoder):
    """The byte-level vocabulary: ids of a text, special tokens' strings as plain text, and the bytes of each id."""

    def __init__(self, name: str) -> None:
        super().__init__(name)
        self.tokenizer.encode_special_tokens = True
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        self.bytes_of = {i: bytes(byte_of[c] for c in t) for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t not in self.special}


class Pieces:
    """The piece vocabulary: ids of a text, chunk by chunk where no piece can reach over a space, and the bytes of each id."""

    def __init__(self, name: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=vocabulary(name))
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes_of = {i: bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)}
        self.parted = all(not p.strip("▁") or "▁" not in p[1:] for p in pieces)
        self.kept = TwoGenerations(_KEPT)

    def _ids(self, text: str) -> bytes:
        return np.array(self.model.encode(text), "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of the text with the space that the model puts before it."""
        if not self.parted or "  " in text or text[:1] == " " or text[-1:] == " " or "▁" in text:
            return self._ids(text)
        out, get, old = [], self.kept.get, self.kept.old.get
        for chunk in text.split(" "):
            if (ids := get(chunk)) is None:
                ids = old(chunk) or self._ids(chunk)
                if len(chunk) <= _LONGEST_KEPT:
                    self.kept[chunk] = ids
            out.append(ids)
        self.kept.make_room()
        return b"".join(out)


def _meet(sizes: tuple[np.ndarray, np.ndarray], shown: tuple[np.ndarray, np.ndarray], a: np.ndarray, b: np.ndarray) -> tuple[int, str, np.ndarray]:
    """Number of groups, the groups as text, and all links (a * 2**32 + b) of one text's two token sequences of equal bytes.

    Between an end and the one before it lies exactly one token of each side, and two tokens overlap in exactly one such
    stretch, so each distinct end is a link. ``shown`` has each id as text behind a comma, then behind a group's mark.
    """
    ends = [np.cumsum(size[x]) for size, x in zip(sizes, (a, b), strict=True)]
    mark = np.zeros(int(ends[0][-1]) + 1, np.uint8)
    mark[ends[0]] = 1
    mark[ends[1]] += 2
    mark = mark[mark > 0]
    ends_here = (mark & 1, mark >> 1)
    at = [np.cumsum(x, dtype=np.int64) - x for x in ends_here]  # the token of each side that an end lies in
    cut = mark == 3
    group = np.cumsum(cut) - cut
    of_a, of_b = (group[x == 1] for x in ends_here)
    # A token comes after its own side's and, A's before B's within a group, after those of the other side.
    place_a = np.arange(len(a)) + np.concatenate(([0], at[1][cut] + 1))[of_a]
    place_b = np.arange(len(b)) + (at[0][cut] + 1)[of_b]
    parts = np.empty(len(a) + len(b), object)
    for place, names, ids, groups in ((place_a, shown[0], a, of_a), (place_b, shown[1], b, of_b)):
        parts[place] = names[ids + (np.diff(groups, prepend=-1) > 0) * (len(names) // 2)]
    return int(cut.sum()), "".join(parts.tolist())[1:], (a[at[0]] << 32) + b[at[1]]


def _aligned(letters: str, pieces: str):
    """Each text's tokens of both sides brought together."""

    def make():
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        sides = (Letters(letters), Pieces(pieces))
        sizes, shown = [], []
        for side, first in zip(sides, ";|", strict=True):
            n = max(side.bytes_of) + 1
            sizes.append(np.array([len(side.bytes_of.get(i, b"")) for i in range(n)], np.int64))
            shown.append(np.array([f"{before}{i}" for before in ("," + first) for i in range(n)], object))
        none = np.zeros(0, np.int64)

        def of(text: str) -> tuple:
            raw = b" " + text.encode()
            a, b = (np.frombuffer(x, "<u4").astype(np.int64) for x in (sides[0].encode(" " + text), sides[1].encode(text)))
            if any(b"".join(map(s.bytes_of.__getitem__, x.tolist())) != raw for s, x in zip(sides, (a, b), strict=True)):
                return 0, 0, 0, 0, "", none, none
            n, groups, links = _meet(sizes, shown, a, b)
            return len(a), len(b), n, len(links), hashlib.sha256(groups.encode()).hexdigest(), *np.unique(links, return_counts=True)

        def step(batch: pa.RecordBatch) -> dict:
            found = [of(t) if t else (0, 0, 0, 0, "", none, none) for t in batch.column("text").to_pylist()]
            *numbers, sha, links, times = zip(*found, strict=True) if found else [()] * 7
            ends = pa.array(np.cumsum([0] + [len(x) for x in links]), pa.int32())
            link, often = np.concatenate([none, *links]), np.concatenate([none, *times])
            columns = [pa.array(x.astype(np.int32)) for x in (link >> 32, link & 0xFFFFFFFF, often)]
            each = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(columns, fields=[pa.field(c, pa.int32()) for c in ("a", "b", "times")]))
            return {"doc_id": batch.column("doc_id"), "groups_sha256": sha, "links": each, **dict(zip(("n_a", "n_b", "n_groups", "n_links"), numbers, strict=True))}

        return step

    return make


def align(docs: DataFrame, letters: str = "byte_bpe_50k.json", pieces: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256 (of ``a1,a2|b1;a3|b2,b3``) and links of every row.

    ``links`` are the distinct ones, an A and a B id and how many times each occurs. A text that is null or empty, or that
    either side does not give back byte by byte, has no tokens, groups and links. What overlaps lies within one text,
    so a row's tokens meet where the row is and never travel.
    """
    prepare(docs.sparkSession)
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<struct<a:int,b:int,times:int>>"
    return map_batches(texts(docs), _aligned(letters, pieces), schema)


def link_counts(aligned: DataFrame) -> DataFrame:
    """a, b, n (rows that hold the link) and best (no other link of its A token is in more) of every link of ``align``'s rows."""
    n = aligned.select(F.inline("links")).groupBy("a", "b").agg(F.count("*").alias("n"))
    return n.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("a")))  # at most one row for each B token


def align_counted(docs: DataFrame, letters: str = "byte_bpe_50k.json", pieces: str = "piece_bpe_32k.model", frequent: int = FREQUENT) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A text that is null or empty, or that either side does not give back byte by byte, has no tokens: zeros and an empty
    column. A text of any length is taken whole. Repeated rows, and rows that share a doc_id, are aligned each for itself, and
    each counts as a document. An empty table gives no rows; columns besides doc_id and text are not read.
    """
    aligned = materialize(align(docs, letters, pieces).select(F.monotonically_increasing_id().alias("row"), "*"), compression="zstd")
    counts = materialize(link_counts(aligned), compression="zstd")
    # Frequent links, a bounded number, go to where the rows are; only the others are shuffled.
    bound = (counts.agg(F.sum("n")).first()[0] or 0) // frequent
    hot = counts.where(F.col("n") > bound)
    each = aligned.select("row", F.inline("links")).join(F.broadcast(hot), ["a", "b"], "left")
    sums = (F.sum(F.col("best").cast("long") * F.col("times")).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    known = each.where(F.col("n").isNotNull()).groupBy("row").agg(*sums)
    rare = each.where(F.col("n").isNull()).select("row", "a", "b", "times")
    others = rare.join(counts.where(F.col("n") <= bound), ["a", "b"]).groupBy("row").agg(*sums)
    total = known.unionByName(others).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    none = F.lit(0).cast("long")
    counted = aligned.drop("links").join(total, "row", "left")
    return counted.select(
        *["doc_id", "n_a", "n_b", "n_groups", "n_links"], F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256"
    )


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' alignments of two tokenizers, with links counted over all documents (see ``align_counted``)."""
    return align_counted(table(spark, sf_dir, "documents"))
