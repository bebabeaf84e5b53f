import json
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from seqloom.llm import packing, token_output
from seqloom.llm.encoding import PieceEncoder
from seqloom.llm.queries import vocabulary

from .fixtures import docs, texts


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_encode_as_whole_texts(name):
    whole = Tokenizer.from_file(vocabulary(name))
    rows = [t or "" for _, t in texts()]
    got = dict(PieceEncoder(vocabulary(name)).encode(rows, at_once_chars=2000))
    for i, t in enumerate(rows):
        assert np.frombuffer(got[i], "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t[:60])


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_awkward_characters_and_stops_encode_as_whole_texts(name):
    rng, some = random.Random(5), "aZé.,' \n\t ßs0\u0661\u02bc\u0250\u01bb\u00aa\u0345\u4e2d.,!\u200b\u0301\u01c5\u1c89"
    texts = ["".join(rng.choice(some) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += ["can't. won't, it's.", "a " + "q" * 60 + ". b", "x, y,. z.. w.\nNew", "q" * 60 + ",", ". , a."]
    enc = PieceEncoder(vocabulary(name))
    for _ in range(2):  # the second time from the store
        assert enc.batch(texts) == [enc.whole(t) for t in texts]
    assert max(map(len, enc.kept)) <= 40


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_texts_are_only_cut_for_known_tokenizers(name, tmp_path):
    assert PieceEncoder(vocabulary(name)).cut
    other = json.loads(open(vocabulary(name)).read())
    other["pre_tokenizer"] = {"type": "Split", "pattern": {"String": "e"}, "behavior": "MergedWithNext", "invert": False}
    path = tmp_path / "other.json"
    path.write_text(json.dumps(other))
    enc, whole = PieceEncoder(str(path)), Tokenizer.from_file(str(path))
    assert not enc.cut
    for t in ("one two three", "here we were", ""):
        assert np.frombuffer(enc.batch([t])[0], "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids


def test_full_store_is_emptied():
    enc = PieceEncoder(vocabulary("byte_bpe_50k.json"), max_pieces=3)
    whole = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    for t in ("one two three four", "five six", "one two"):
        assert np.frombuffer(enc.batch([t])[0], "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("counts", [[1], [3, 1], [5, 5, 5], [1000, 1, 1, 1, 1], list(np.random.default_rng(0).zipf(1.3, 400).clip(0, 10**9))])
def test_code_is_prefix_free_and_optimal(counts):
    counts = np.array(counts)
    lengths = token_output.code_lengths(counts, 12)
    used = lengths[counts > 0]
    assert (used >= 1).all() and used.max() <= 12 and (2.0**-used).sum() <= 1
    if len(counts) > 1:
        import heapq

        heap = [int(c) for c in counts]
        heapq.heapify(heap)
        cost = 0
        while len(heap) > 1:
            s = heapq.heappop(heap) + heapq.heappop(heap)
            cost += s
            heapq.heappush(heap, s)
        free = token_output.code_lengths(counts, 40)
        assert (free * counts).sum() == cost <= (lengths * counts).sum()


def test_length_limit_against_dynamic_programme():
    """Limited to 3 bits: the best of all length choices."""
    import itertools

    counts = np.array([100, 20, 3, 2, 1])
    best = min((np.array(c) * counts).sum() for c in itertools.product(range(1, 4), repeat=5) if (2.0 ** -np.array(c)).sum() <= 1)
    assert (token_output.code_lengths(counts, 3) * counts).sum() == best


def test_bits_round_trip():
    rng = np.random.default_rng(2)
    for n in (0, 1, 255, 256, 257, 5000):
        ids = rng.zipf(1.4, n).clip(0, 3000).astype(np.int64)
        lengths = token_output.code_lengths(np.bincount(ids, minlength=3001))
        bits, at = token_output.pack_bits(ids, lengths, token_output.canonical_codes(lengths))
        got = token_output.unpack_bits(bits, n, at[:: token_output.STEP].astype("<u8"), token_output.decode_table(lengths))
        assert got.tolist() == ids.tolist()


def by_id(rows):
    return sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))


def test_token_file(spark):
    rows = texts()
    whole = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    got = token_output.token_output(docs(spark, rows, clashing=True), vocabulary("byte_bpe_50k.json")).toPandas()
    want, start, last = [], 0, object()
    each = []
    for i, t in by_id(rows):
        ids = [*whole.encode(t, add_special_tokens=False).ids, 0]
        each.append((i, len(ids), ids))
    each.sort(key=lambda e: (e[0] is not None, e[0] or 0, e[1]))
    for i, n, ids in each:
        want.append((i, start, n, zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += n
    out = sorted(((None if r.doc_id != r.doc_id else int(r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in got.itertuples()), key=lambda r: r[1])
    assert out == want
    del last


def test_token_file_of_an_empty_table(spark):
    assert token_output.token_output(docs(spark, []), vocabulary("byte_bpe_50k.json")).count() == 0


def test_read_back_gives_the_ids(spark, tmp_path):
    rows = [(1, "one two"), (2, None)]
    token_output.write_ids(docs(spark, rows), f"file://{tmp_path}/ids", vocabulary("byte_bpe_50k.json"))
    got = {r.doc_id: list(r.ids) for r in token_output.read_ids(spark, f"file://{tmp_path}/ids", with_ids=True).collect()}
    whole = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    assert got == {1: [*whole.encode("one two").ids, 0], 2: [0]}


def check_plan(counts, capacity=4096):
    runs, n_seq = packing.plan(counts, capacity)
    filled: dict = {}
    placed = dict.fromkeys(counts, 0)
    for length, rank, count, first, offset in runs.tolist():
        assert rank == placed[length]
        placed[length] += count
        for j in range(count):
            filled.setdefault(first + j, []).append((offset, length))
    assert placed == counts
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(filled) == n_seq
    return n_seq


def test_plan_places_everything():
    rng = np.random.default_rng(4)
    assert check_plan({}) == 0
    assert check_plan({4096: 3}) == 3
    assert check_plan({2049: 5}) == 5
    assert check_plan({1: 10000}) == 3
    for _ in range(4):
        lengths, n = np.unique(rng.lognormal(6, 1.2, 3000).astype(int).clip(1, 4096), return_counts=True)
        counts = dict(zip(lengths.tolist(), n.tolist(), strict=True))
        assert check_plan(counts) <= -(-sum(k * v for k, v in counts.items()) // 4096) * 1.01 + 1


def best_fit_decreasing(lengths, capacity):
    """Number of sequences, one piece after another."""
    import bisect

    rooms, opened = [], 0
    for x in sorted(lengths, reverse=True):
        k = bisect.bisect_left(rooms, x)
        room = rooms.pop(k) if k < len(rooms) else capacity
        opened += room == capacity
        if room - x:
            bisect.insort(rooms, room - x)
    return opened


@pytest.mark.parametrize("kind", ["uniform", "narrow", "middle", "two humps", "few sizes"])
def test_plan_is_never_worse_than_best_fit_decreasing(kind):
    rng = np.random.default_rng(7)
    n = 60_000 if kind == "uniform" else 5_000
    drawn = {
        "uniform": lambda: rng.integers(1, 4097, n), "narrow": lambda: rng.integers(1400, 2801, n), "middle": lambda: rng.integers(600, 2201, n),
        "two humps": lambda: np.concatenate([rng.normal(1500, 100, n // 2), rng.normal(2600, 200, n // 2)]).astype(int).clip(1, 4096),
        "few sizes": lambda: rng.choice([700, 900, 1300, 1366, 1500, 2000], n),
    }[kind]()
    lengths, counts = np.unique(drawn, return_counts=True)
    n_seq = check_plan(dict(zip(lengths.tolist(), counts.tolist(), strict=True)))
    assert n_seq <= best_fit_decreasing(drawn.tolist(), 4096)
    if kind == "uniform":
        assert n_seq <= 1.005 * max(-(-int(drawn.sum()) // 4096), int((drawn > 2048).sum()))


def test_plan_on_many_short_pieces():
    """Lognormal lengths: within 1 in 1,000 of best fit decreasing, which fills them almost without a gap."""
    drawn = np.random.default_rng(2).lognormal(6.2, 1.0, 40_000).astype(int).clip(1, 4096)
    lengths, counts = np.unique(drawn, return_counts=True)
    assert check_plan(dict(zip(lengths.tolist(), counts.tolist(), strict=True))) <= 1.001 * best_fit_decreasing(drawn.tolist(), 4096)


def test_every_plan_comes_from_configurations(monkeypatch):
    called = []
    found = packing.configurations
    monkeypatch.setattr(packing, "configurations", lambda sizes, need, capacity: called.append((len(sizes), sum(need))) or found(sizes, need, capacity))
    for counts in ({600: 7, 30: 9}, {4000: 1, 2000: 50, 513: 4}, {k: 3 for k in range(520, 4096, 7)}):
        called.clear()
        check_plan(counts)
        assert called and all(n == sum(v for k, v in counts.items() if k > 512) for _, n in called)
    assert 0 not in packing.N_GROUPS


def test_best_configuration_against_brute_force():
    import itertools

    rng = np.random.default_rng(3)
    for _ in range(20):
        sizes, values = sorted(rng.choice(np.arange(11, 60), 4, replace=False).tolist()), rng.random(4)
        worth, picked = packing.best_configuration(sizes, values, 100)
        every = [c for c in itertools.product(*(range(100 // x + 1) for x in sizes)) if np.dot(c, sizes) <= 100]
        assert abs(worth - max(np.dot(c, values) for c in every)) < 1e-9 and abs(np.dot(picked, values) - worth) < 1e-9
        assert np.dot(picked, sizes) <= 100


def test_plan_against_best_small_packing():
    """Three thirds and pairs of halves: the optimum is known."""
    assert check_plan({40: 30, 60: 30}, 100) == 30
    assert check_plan({33: 30, 34: 15}, 100) == 15
    assert check_plan({50: 7, 51: 7, 49: 7}, 100) <= 11


def test_pack(spark):
    rows = texts()
    whole = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    got = packing.pack(docs(spark, rows, clashing=True), vocabulary("word_bpe_49k.json"), capacity=512).toPandas()
    want = []
    for i, t in rows:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(-1 if i is None else i, p, at, len(ids[at : at + 512]), zlib.crc32(ids[at : at + 512].tobytes())) for p, at in enumerate(range(0, len(ids), 512))]
    out = sorted((-1 if r.doc_id != r.doc_id else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples())
    assert out == sorted(want)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g.length.cumsum() - g.length == g.offset).all() and g.length.sum() <= 512
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 512) + 2
    assert packing.pack(docs(spark, []), vocabulary("word_bpe_49k.json")).count() == 0
