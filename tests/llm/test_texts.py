"""Operators on texts against brute force, on small tables with every odd case."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from triplicate.llm import bpe, common, components, packing, pii, secrets, simhash, substrings, token_files, tokens, toxicity

WORDS = ["the", "of", "Alpha", "beta", "gamma", "delta", "été", "naïve", "x1", "don't", "42", "—", "zeta,", "eta.", "theta"]


def odd_texts():
    rng = random.Random(5)
    passage = " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(60))
    out = [None, "", " ", "one", "\n\t two  words ", passage, passage, passage + " more", "begin " + passage, "a" * 3000, " ".join(["same"] * 400), "<|endoftext|> x <|startoftext|>"]
    out += [" ".join(rng.choice(WORDS) + str(rng.randint(0, 30)) for _ in range(rng.randint(1, 120))) for _ in range(60)]
    out += [" ".join(passage.split()[rng.randint(0, 20) : rng.randint(25, 60)]) + " tail" for _ in range(10)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", -1) for i, t in enumerate(odd_texts())] + [(5, odd_texts()[5], "en", -1)]
    # Columns whose names clash with what operators make.
    return spark.createDataFrame(rows, "doc_id long, text string, digest string, part int").cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("doc_id < 0")


def test_pii_base_and_disguises(docs, empty):
    rows = pii.find_pii(docs).collect()
    assert len(rows) == docs.count() and not pii.find_pii(empty).collect()
    cases = {
        "mail joe.smith (at) mail dot example dot com now": "joe.smith (at) mail dot example dot com",
        "jo​e@exa​mple.com": "jo​e@exa​mple.com",
        "ｊoe＠example．com": "ｊoe＠example．com",
        "plus one five five five one two three four five six seven": "plus one five five five one two three four five six seven",
        "four one one one one one one one one one one one one one one one": "four one one one one one one one one one one one one one one one",
        "10[.]0[.]0[.]1": "10[.]0[.]0[.]1",
    }
    for text, hidden in cases.items():
        base, added = pii.find(text)
        assert not base and [text[a:b] for _, a, b in added] == [hidden]
    assert pii.find("look at b. The one of two") == ([], [])


@pytest.mark.parametrize(
    ("text", "kind", "hidden"),
    [
        ("host one nine two dot one six eight dot zero dot one is up", "ip", "one nine two dot one six eight dot zero dot one"),
        ("host one zero dot zero dot zero dot one is up", "ip", "one zero dot zero dot zero dot one"),
        ("host one zero [.] zero [dot] zero (.) one is up", "ip", "one zero [.] zero [dot] zero (.) one"),
        ("host zero dot zero dot zero dot zero", "ip", "zero dot zero dot zero dot zero"),
        ("host one nine two.one six eight.zero.one", "ip", "one nine two.one six eight.zero.one"),
        ("host 192.168.0.one", "ip", "192.168.0.one"),
        ("host 192.168.zero.one", "ip", "192.168.zero.one"),
        ("call plus four nine (one five one) two three four five six seven eight", "phone", "plus four nine (one five one) two three four five six seven eight"),
        ("call plus four nine (zero) (one five) two three four five six seven eight", "phone", "plus four nine (zero) (one five) two three four five six seven eight"),
        ("call plus four nine 151 2345678", "phone", "plus four nine 151 2345678"),
        ("call plus,four,nine,one,five,one,two,three,four,five,six", "phone", "plus,four,nine,one,five,one,two,three,four,five,six"),
        ("plus triple nine double nine triple nine double nine", "phone", "plus triple nine double nine triple nine double nine"),
        ("card four,one,one,one,one,one,one,one,one,one,one,one,one,one,one,one", "card", "four,one,one,one,one,one,one,one,one,one,one,one,one,one,one,one"),
        ("card four.one.one.one.one.one.one.one.one.one.one.one.one.one.one.one", "card", "four.one.one.one.one.one.one.one.one.one.one.one.one.one.one.one"),
        ("card triple zero triple zero triple zero triple zero double zero", "card", "triple zero triple zero triple zero triple zero double zero"),
        ("card 4lll 1111 1111 1111 one of two", "card", "4lll 1111 1111 1111"),
    ],
)
def test_pii_spelled_in_short_runs_and_with_any_separator(text, kind, hidden):
    base, added = pii.find(text)
    assert not base and [(k, text[a:b]) for k, a, b in added] == [(kind, hidden)]


def test_pii_names_of_digits_alone_are_no_identifier():
    for text in ("one dot. Two plus two is four, 3 one", "version 1.2 two", "un plus un", "plus one 5", "one, two. three"):
        assert pii.find(text) == ([], [])


def test_pii_base_is_the_plain_patterns():
    def plain(t):
        out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            d = [int(c) for c in m[0] if c.isdigit()][::-1]
            if 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0:
                out.append(("card", *m.span()))
        out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
        return out

    rng = random.Random(2)
    pieces = [*"abZ09.@+- ()", "1.2.3.4", "255", "256", "4111 1111 1111 1111", "@b.c", "4444"]
    for _ in range(5000):
        t = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 25)))
        assert pii.detect(t) == plain(t)


def test_redaction_leaves_the_rest(spark):
    rows = spark.createDataFrame([(1, "a joe@x.org b"), (2, None), (3, "clean")], "doc_id long, text string")
    assert [r.text for r in pii.redact_pii(rows).orderBy("doc_id").collect()] == ["a [EMAIL] b", None, "clean"]


def test_secrets(spark, docs, empty):
    def plain(t):
        out = []
        for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
            out += [(m.start(), 0, m.end(), "assign")] if len(m[1]) >= 6 else []
        out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))

    rng = random.Random(3)
    pieces = ["password", "=", ": ", "token", '"', "abcdef", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", " ", "é", "😀", "api_key", "\n"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) for _ in range(400)] + [None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secrets.find_secrets(rows).collect():
        assert r.base_sha256 == hashlib.sha256(plain(texts[r.doc_id] or "").encode()).hexdigest()
    one = spark.createDataFrame([(1, "x Pq7Lm2Xc9Vb4Nk8Rt5Wy y 123e4567-e89b-12d3-a456-426614174000")], "doc_id long, text string")
    assert secrets.find_secrets(one).first().spans == "entropy:2:22"
    assert secrets.find_secrets(docs).count() == docs.count() and secrets.find_secrets(empty).count() == 0


def test_entropy_is_that_of_the_most_random_window(spark):
    def most(c: str) -> float:
        windows = [c[i : i + 20] for i in range(len(c) - 19)]
        return max(-sum(n / 20 * math.log2(n / 20) for n in Counter(w).values()) for w in windows)

    r = random.Random(5)
    rows = ["".join(r.choice(secrets.LETTERS[:k]) for _ in range(n)) for n in (20, 21, 60) for k in (1, 3, 66)]
    found = spark.createDataFrame([(c,) for c in rows], "c string").select(secrets.most_bits(F.col("c"))).collect()
    assert np.allclose([f[0] for f in found], [most(c) for c in rows])


def test_secrets_in_a_very_long_run_and_in_very_many(spark):
    r = random.Random(6)
    blob = "".join(r.choice("Qa7bZc3dXeYf9gWhVi5jUk1") for _ in range(200_000))
    many = " ".join(f"{i:05d}abcdef0123456789abcdef" for i in range(3000))
    rows = secrets.find_secrets(spark.createDataFrame([(1, blob), (2, many)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert rows[0].spans == "entropy:0:200000"
    assert rows[1].n_hex == 3000 and rows[1].spans.endswith(f":{len(many) - 27}:{len(many)}")


def test_bpe_is_the_librarys(spark, docs, empty):
    library = tokens.load("word_bpe_49k.json")
    for r in bpe.encode_decode(docs).collect():
        ids = library.encode(odd_texts()[r.doc_id] or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids
        assert r.decoded == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode_decode(empty).count() == 0


def test_merge_takes_leftmost_of_lowest_rank():
    pairs = {1 << 32 | 1: (0, 2), 2 << 32 | 1: (1, 3)}
    assert bpe.merge([1, 1, 1], pairs) == [3]
    assert bpe.merge([1], pairs) == [1] and bpe.merge([], pairs) == []


def test_byte_encoder_is_the_librarys():
    encoder, library = tokens.ByteEncoder("byte_bpe_50k.json"), tokens.load("byte_bpe_50k.json")
    rng = random.Random(1)
    pieces = ["a", "b ", " ", "\n", "\t", "the", "'s", "<|endoftext|>", "é", "12", "!!", "　", "\x1c", "\r\n", "日本", "  "]
    for t in [*(x or "" for x in odd_texts()), *("".join(rng.choice(pieces) for _ in range(rng.randint(0, 9))) for _ in range(3000))]:
        assert encoder.encode(t) == np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_token_files_round_trip(spark, docs, empty, tmp_path):
    library = tokens.load("byte_bpe_50k.json")
    token_files.write_tokens(docs, str(tmp_path / "t"))
    rows = token_files.read_tokens(spark, str(tmp_path / "t")).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in rows) and len(rows) == docs.count()
    at = 0
    for r in rows:
        assert r.start == at and r.ids == [*library.encode(odd_texts()[r.doc_id] or "", add_special_tokens=False).ids, 0]
        at += r.n_tokens
    assert token_files.read_tokens(spark, str(tmp_path / "t"), [3]).first().doc_id == 3
    token_files.write_tokens(empty, str(tmp_path / "e"))
    assert token_files.read_tokens(spark, str(tmp_path / "e")).count() == 0


def test_packing(docs, empty):
    rows = packing.pack(docs, size=64).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    library = tokens.load("byte_bpe_50k.json")
    for doc in {r.doc_id for r in rows} - {5}:
        ids = [*library.encode(odd_texts()[doc] or "", add_special_tokens=False).ids, 0]
        pieces = sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.piece)
        assert len(pieces) == -(-len(ids) // 64) and sum(r.length for r in pieces) == len(ids)
        for r in pieces:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    assert len(by) <= 1.05 * sum(r.length for r in rows) / 64 + 2
    many = packing.pack(docs, size=64, group=10).collect()  # several buckets
    assert sum(r.length for r in many) == sum(r.length for r in rows) and len({r.sequence_id >> 40 for r in many}) > 3
    held = {}
    for r in many:
        held.setdefault(r.sequence_id, []).append((r.offset, r.offset + r.length))
    assert all(a == b for places in held.values() for (_, a), (b, _) in zip(sorted(places), sorted(places)[1:]))
    assert packing.pack(empty).count() == 0


def test_few_open_bins_waste_little():
    rng = random.Random(2)
    lengths = [rng.choice((rng.randint(1, 2048), rng.randint(1, 400))) for _ in range(20_000)]
    least = sum(lengths) / 2048
    packer = packing.BestFit(2048, packing.OPEN)
    for n in lengths:
        packer.put(n)
        assert packer.open <= packing.OPEN and packer.open == sum(map(len, packer.by_free))
    assert packer.made <= 1.04 * least
    assert packing.BestFit(2048, 4).bins == 4 and len({b for b, _ in packing.best_fit(lengths, 2048, 4)}) > packer.made


def test_fullest_bin_closes_first():
    assert packing.best_fit([6, 5, 4, 3, 5], 10, bins=1) == [(0, 0), (1, 0), (1, 5), (2, 0), (2, 3)]


@pytest.mark.parametrize("run, frequent", [(1 << 16, 1000), (4, 3)])
def test_simhash_links(docs, empty, monkeypatch, run, frequent):
    monkeypatch.setattr(simhash, "RUN", run)
    for module in (common, components):
        monkeypatch.setattr(module, "FREQUENT", frequent)
    rows = {(r.doc_id): r for r in simhash.near_duplicates(docs).collect()}
    texts = dict(enumerate(t or "" for t in odd_texts()))
    prints = {i: simhash.fingerprint(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in texts:
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    for i in texts:
        assert rows[i].fingerprint == f"{prints[i]:016x}" and rows[i].component_id == find(i)
    assert simhash.near_duplicates(empty).count() == 0


def test_trie_join_is_brute_force():
    rng = random.Random(1)
    for _ in range(40):
        centres = [rng.getrandbits(64) for _ in range(4)]
        keys = sorted({c ^ sum(1 << rng.randrange(64) for _ in range(3)) & (1 << 64) - 1 for c in centres for _ in range(15)} | set(centres))
        roots = simhash.TrieJoin(keys, 2).join()
        label = list(range(len(keys)))
        for _ in keys:
            for i, x in enumerate(keys):
                for j, y in enumerate(keys):
                    if (x ^ y).bit_count() <= 2:
                        label[i] = label[j] = min(label[i], label[j])
        assert {frozenset(i for i, r in enumerate(roots) if r == x) for x in roots} == {frozenset(i for i, r in enumerate(label) if r == x) for x in label}


def test_similar_texts_are_dropped(spark):
    rng = random.Random(9)
    base = [f"w{rng.randint(0, 500)}" for _ in range(300)]
    near = base[:150] + ["changed"] + base[151:]
    other = [f"v{rng.randint(0, 500)}" for _ in range(300)]
    rows = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(base)), (3, " ".join(near)), (4, " ".join(other)), (5, None)], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(rows).collect()) == [1, 4, 5]


def shingle_sets(texts):
    return [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in texts)]


def smallest_reachable(sets):
    root = list(range(len(sets)))
    for _ in sets:
        before = list(root)
        for i, x in enumerate(sets):
            for j, y in enumerate(sets[:i]):
                if root[i] != root[j] and len(x & y) / len(x | y) >= 0.8:
                    root[i] = root[j] = min(root[i], root[j])
        if root == before:
            return root


@pytest.mark.parametrize("block", [1 << 20, 400])
def test_similar_texts_are_those_of_jaccard_similarity(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    if block == 400:  # runs and frequent values are split as well
        monkeypatch.setattr(simhash, "RUN", 8)
        for module in (common, components):
            monkeypatch.setattr(module, "FREQUENT", 5)
    rng = random.Random(11)
    texts = []
    for _ in range(250):  # pairs of similarity 0.6 to 0.9 by scattered edits
        base = [f"w{rng.randint(0, 9999)}" for _ in range(rng.choice((8, 40, 120)))]
        near = list(base)
        for at in rng.sample(range(len(near)), max(1, round(len(near) * rng.uniform(0.01, 0.06)))):
            near[at] = "changed"
        texts += [" ".join(base), " ".join(near)]
    centre = [f"c{rng.randint(0, 9999)}" for _ in range(60)]
    for _ in range(40):  # a group that is dense in pairs on both sides of the limit
        copy = list(centre)
        copy[rng.randrange(60)] = f"x{rng.randint(0, 99)}"
        texts.append(" ".join(copy[: rng.randint(50, 60)]))
    sets = shingle_sets(texts)
    near = [len(x & y) / len(x | y) for x, y in zip(sets[:500:2], sets[1:500:2])]
    assert sum(0.6 <= s < 0.8 for s in near) > 20 and sum(0.8 <= s < 0.9 for s in near) > 20
    rows = simhash.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in rows} == dict(enumerate(smallest_reachable(sets)))


@pytest.mark.parametrize("block, group", [(2 << 20, 4096), (600, 4096), (600, 2)])
def test_substrings(docs, empty, monkeypatch, block, group):
    monkeypatch.setattr(substrings, "BLOCK_BYTES", block)
    monkeypatch.setattr(substrings, "GROUP", group)
    texts = [t or "" for t in odd_texts()]
    words = [t.encode().split() for t in texts]
    first = {}
    for i, w in enumerate(words):
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    rows = {r.doc_id: r for r in substrings.count_kept(docs).collect()}
    for i, w in enumerate(words):
        gone = [any(first[tuple(w[k : k + 13])] < i for k in range(max(0, j - 12), min(j, len(w) - 13) + 1)) for j in range(len(w))]
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        assert (rows[i].n_words, rows[i].n_removed, rows[i].kept_sha256) == (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    cut = {r.doc_id: r for r in substrings.remove_duplicates(docs).collect()}
    assert cut[0].text is None and cut[4].text == texts[4] and cut[6].text == "" and cut[8].text == "begin" and cut[0].digest == "en"
    assert substrings.count_kept(empty).count() == 0 and substrings.remove_duplicates(empty).columns == empty.columns


def test_factors_are_greedy_and_cross_their_ends():
    a, b = [b"a%d" % i for i in range(30)], [b"b%d" % i for i in range(30)]
    index = {}
    assert substrings.factors(a, 1, index) == [] and substrings.factors(a, 1, index) == []
    assert substrings.factors(a[10:] + b, 2, index) == [(0, 8)]
    got = substrings.factors(a[2:] + b[:14], 3, index)
    assert {k for i, n in got for k in range(i, i + n)} == set(range(28 + 14 - 12))


def test_passages_of_rows_without_doc_id_and_of_odd_columns(spark):
    import datetime

    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(None, "x " + passage, [1, None], datetime.datetime(2020, 1, 1), "a"), (3, passage, None, None, None), (9, passage + " y", [2], None, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block array<int>, id timestamp, ID2 string")
    out = {r.doc_id: r for r in substrings.remove_duplicates(docs).collect()}
    assert (out[None].text, out[3].text, out[9].text) == ("x", passage, "y") and out[None].block == [1, None] and out[None].id == rows[0][3]


def test_kernel_is_the_sum_over_subsequences():
    from itertools import combinations

    def slow(s, t):
        def weights(s):
            out = {}
            for c in combinations(range(len(s)), toxicity.LENGTH):
                key = "".join(s[i] for i in c)
                out[key] = out.get(key, 0) + toxicity.DECAY ** (c[-1] - c[0] + 1)
            return out

        a, b = weights(s), weights(t)
        return sum(v * b.get(k, 0) for k, v in a.items())

    marks = ["idiot", "idaho", "banana", "cabcab", "xy"]
    values = toxicity.kernel(["idiot", "i-d-iot", "bananas", "ab"], marks)
    for i, s in enumerate(["idiot", "i-d-iot", "bananas", "ab"]):
        for j, t in enumerate(marks):
            assert abs(values[i, j] - slow(s, t)) < 1e-4


def test_toxicity_learns_and_tolerates_insertions(spark):
    rng = random.Random(4)
    clean = [f"{rng.choice('bcdfgh')}{rng.choice('aeo')}{rng.choice('lmnr')}{rng.choice('aeo')}{rng.choice('stk')}" for _ in range(80)]
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        words = [rng.choice(clean) for _ in range(40)] + ([rng.choice(["fuzzwit", "grumbletoad"])] if bad else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    rows += [(400, "balas fuzz.wit melos"), (401, None), (402, "balas f u z z w i t"), (403, "balas melos")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    found = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert all((found[i] >= 0.5) == bool(bad) for i, bad in labels)
    assert found[400] >= 0.5 and found[402] >= 0.5 and found[401] < 0.5 and found[403] < 0.5
    nobody = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs, nobody).count() == len(rows)


def test_toxicity_of_every_row_alone_and_never_from_what_is_held_out(spark, tmp_path):
    rng = random.Random(8)
    letters = "bcdfghlmnprst"
    rows = []
    for i in range(300):
        said = ["".join(rng.choice(letters) for _ in range(rng.randint(3, 7))) for _ in range(30)]
        if i % 3 == 0:
            said[rng.randrange(30)] = rng.choice(["grumbletoad", "x" * 30 + "grumbletoad", "q" * 57 + "fuzzwit", "fuzzwit"])
        rows.append((i, " ".join(said), i % 3 == 0))
    odd = [(1000 + i, t, False) for i, t in enumerate(odd_texts())] + [(1003, "one", False)]
    docs = spark.createDataFrame([(i, t, "z") for i, t, _ in rows + odd], "doc_id long, text string, score string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(b)) for i, _, b in rows] + [(5, None)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    found = toxicity.op10_toxicity(spark, str(tmp_path)).collect()
    assert len(found) == len(rows) + len(odd)
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    assert all(r.held_out == held(r.doc_id) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in found)
    score = {r.doc_id: r.score for r in found}
    wrong = [i for i, _, b in rows if held(i) and (score[i] >= 0.5) != b]
    assert len(wrong) <= 0.1 * sum(held(i) for i, _, _ in rows)
    flipped = [(i, int(b != held(i))) for i, _, b in rows]
    model = toxicity.train(docs, spark.createDataFrame(flipped, "doc_id long, toxic int"))
    for i, t, _ in rows[:20] + odd:
        alone = toxicity.Scorer(model).score([t or ""])[0]
        assert abs(alone - score[i]) < 1e-6
    assert sorted(r.doc_id for r in toxicity.drop_toxic(docs, model).collect()) == sorted(r.doc_id for r in found if r.score < 0.5)
    assert toxicity.drop_toxic(docs.limit(0), model).columns == docs.columns and toxicity.score(docs.limit(0), model).count() == 0
