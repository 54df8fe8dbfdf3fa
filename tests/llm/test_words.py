"""Spelling variants, token counts and alignments against brute force, on small tables with every odd case."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from tokenizers import Tokenizer

from triplicate.llm import alignment, spelling, token_counts, tokens


def odd_texts():
    rng = random.Random(11)
    letters = "abcdeéñßÿÀ"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 9))) for _ in range(40)]
    near = []
    for w in words:
        for _ in range(6):
            i, c = rng.randrange(len(w)), rng.choice(letters)
            near.append(rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]]))
    words += near
    out = [None, "", " ", "one", "\n\t two  words ", "<|endoftext|> x <s> y <|startoftext|>", "a▁b", " lead", "trail ", "ab\x00c d", "x y z", "Ünïcode 漢字 emoji 🎉 done", "don't  stop\n\n now"]
    out += [" ".join(rng.choice(words) + rng.choice(["", "", ",", ".\n", "X"]) for _ in range(rng.randint(1, 150))) for _ in range(80)]
    return [*out, "word " * 200_000 + "y" * 100_000]  # 1.1 MB


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, -1, "x", True) for i, t in enumerate(odd_texts())] + [(15, odd_texts()[15], -1, "x", True), (15, "other text", -1, "x", False), (None, odd_texts()[20], 0, "", None)]
    # Columns whose names clash with what operators make.
    return spark.createDataFrame(rows, "doc_id long, text string, n long, word string, best boolean").cache()


def rows_of(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_by_hand(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {w: best for w in n if near[w] and n[best := min(near[w], key=lambda v: (-n[v], v))] >= 2 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n}


def test_spelling_variants_by_hand(spark, docs):
    found = spelling.spelling_variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(found) == len(set(found)) and {tuple(r) for r in found} == variants_by_hand(rows_of(docs))
    assert sum(r.form is not None for r in found) > 20 and any(r.root != r.form for r in found if r.form)
    assert not spelling.spelling_variants(docs.where("false")).collect()


def test_every_single_edit_meets_once(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("aeinrst") for _ in range(7)) for _ in range(60)]
    edits = {w[:i] + c + w[i + d :] for w in base for i in range(8) for c in ("", "a", "ö", "z") for d in (0, 1)} | set(base)
    words = sorted(w for w in edits if len(w) >= 5)
    found = spelling.near_pairs(spark.createDataFrame([(w, 3) for w in words], "word string, n long")).collect()
    pairs = [tuple(sorted((r.word, r.other))) for r in found]
    shorter = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            shorter[w[:i] + w[i + 1 :]].add(w)
    wanted = {tuple(sorted((a, w))) for a in words for w in shorter.get(a, ())} | {(a, b) for s in shorter.values() for a in s for b in s if a < b and one_edit(a, b)}
    assert len(pairs) == len(set(pairs)) and set(pairs) == wanted


@pytest.mark.parametrize("size", [1 << 16, 5, 0])
def test_token_counts_by_the_library(docs, size):
    library = Tokenizer.from_file(tokens.vocabulary("byte_bpe_50k.json"))
    library.no_truncation()
    library.no_padding()
    found = token_counts.count_tokens(docs, size=size).collect()
    wanted = Counter((d, len(t.encode()), n := len(library.encode(t, add_special_tokens=False).ids), n > 1024) for d, t in rows_of(docs))
    assert Counter(tuple(r) for r in found) == wanted
    assert not token_counts.count_tokens(docs.where("false")).collect()


def test_length_table_compares_whole_pieces():
    pieces = [b"", b"a", b"a\x00", b"abcdefgh", b"abcdefghi", b"abcdefghijklmnop"]
    known = token_counts.LengthTable(pieces, [1, 2, 3, 4, 5, 6])
    import numpy as np

    asked = [*pieces, b"b", b"\x00", b"abcdefg", b"abcdefghijklmnoq", b"abcdefghijklmnopq"]
    size = np.array([len(p) for p in asked])
    raw = np.frombuffer(b"".join(asked) + bytes(24), np.uint8)
    assert known.find(raw, np.cumsum(size) - size, size).tolist() == [1, 2, 3, 4, 5, 6, -1, -1, -1, -1, -1]


def alignment_by_hand(rows):
    a_side, b_side = alignment.Letters("byte_bpe_50k.json"), alignment.Pieces("piece_bpe_32k.model")
    out, linked = [], []
    for doc, text in rows:
        groups, links = [], []
        if text:
            library = a_side.tokenizer.encode(" " + text, add_special_tokens=False).ids
            sides = []
            for ids, known in ((library, a_side.bytes_of), (b_side.model.encode(text), b_side.bytes_of)):
                at, spans = 0, []
                for i in ids:
                    spans.append((at, at := at + len(known[i]), i))
                sides.append((spans, b"".join(known[i] for i in ids)))
            if all(raw == b" " + text.encode() for _, raw in sides):
                (a, _), (b, _) = sides
                cuts = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
                for lo, hi in zip([0, *cuts], cuts, strict=False):
                    parts = [[str(i) for s, e, i in x if lo <= s and e <= hi] for x in (a, b)] if len(text) < 5000 else []
                    groups.append("|".join(",".join(p) for p in parts))
                j = 0
                for s, e, i in a:
                    while j and b[j][0] > s:
                        j -= 1
                    while b[j][1] <= s:
                        j += 1
                    k = j
                    while k < len(b) and b[k][0] < e:
                        links.append((i, b[k][2]))
                        k += 1
        out.append((doc, len(a) if groups else 0, len(b) if groups else 0, groups, links))
        linked.append(set(links))
    count = Counter(x for s in linked for x in s)
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    shown = []
    for doc, n_a, n_b, groups, links in out:
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups and groups[0] else "" if not groups else None
        shown.append((doc, n_a, n_b, len(groups), len(links), sum(count[x] == most[x[0]] for x in links), sum(count[x] for x in links), sha))
    return shown


@pytest.mark.parametrize("frequent", [1 << 17, 50])
def test_alignment_by_hand(docs, frequent):
    found = Counter(tuple(r) for r in alignment.align_counted(docs, frequent=frequent).collect())
    wanted = alignment_by_hand(rows_of(docs))
    long_one = {r[0] for r in wanted if r[7] is None}  # its groups are too many to print by hand here
    assert Counter({(*r[:7], None) if r[0] in long_one else r: k for r, k in found.items()}) == Counter(wanted)
    assert sum(r[7] == "" for r in wanted) >= 3


def test_alignment_of_nothing(docs):
    assert not alignment.align_counted(docs.where("false")).collect()


def test_alignment_tokens_stay_in_their_row(docs):
    """Tokens of a row meet where the row is: alignment shuffles nothing, and repeated links travel once."""
    aligned = alignment.align(docs)
    assert "Exchange" not in aligned._jdf.queryExecution().executedPlan().toString()
    for r in aligned.collect():
        pairs = [(x.a, x.b) for x in r.links]
        assert len(pairs) == len(set(pairs)) and sum(x.times for x in r.links) == r.n_links
