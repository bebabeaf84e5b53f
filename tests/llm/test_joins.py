"""Operators 11 to 13 against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from seqloom.llm import conversation_repair as repair
from seqloom.llm import jaccard_join as join
from seqloom.llm import spelling

from .fixtures import docs, prose, texts

# --- 11 -----------------------------------------------------------------------


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < 3:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 3]) for i in range(len(words) - 2)}


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 90 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(lambda: 1 << 62)
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(least[find(i)], 1 << 61 if k is None else k)
    return Counter((k, len(sets[i]), k if not sets[i] else (None if least[find(i)] == 1 << 61 else least[find(i)])) for i, (k, _) in enumerate(rows))


def near_copies(rng, base, n, edits):
    out = []
    for _ in range(n):
        words = base.split()
        for _ in range(rng.randint(0, edits)):
            at = rng.randrange(len(words))
            match rng.randrange(3):
                case 0:
                    words[at] = f"w{rng.randrange(10**6)}"
                case 1:
                    del words[at]
                case _:
                    words.insert(at, f"w{rng.randrange(10**6)}")
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("crowd", [16, 2])
def test_jaccard_components(spark, monkeypatch, crowd):
    monkeypatch.setattr(join, "CROWD", crowd)
    rng = random.Random(5)
    rows = texts(40)
    for words, n, edits in ((12, 12, 1), (60, 25, 3), (160, 40, 6), (400, 12, 12)):
        rows += [(len(rows) + 1000, t) for t in near_copies(rng, prose(rng, words), n, edits)]
    found = join.jaccard_components(docs(spark, rows, clashing=True)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute_components(rows)


def test_shared_blocks(spark):
    """Texts of the same few blocks are much alike without being linked."""
    rng = random.Random(6)
    blocks = [prose(rng, 25) for _ in range(12)]
    rows = [(i, "\n".join(rng.sample(blocks, 5))) for i in range(120)]
    rows += [(500 + i, t.replace("ta", "TA").upper()) for i, t in rows[:5]]
    found = join.jaccard_components(docs(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute_components(rows)


def test_jaccard_empty_table(spark):
    assert join.jaccard_components(docs(spark, [])).collect() == []


def test_similar_sets_meet_under_a_key_that_is_asked_for():
    rng = np.random.default_rng(1)
    for percent in (90, 80):
        for _ in range(400):
            size = int(rng.integers(2, 400))
            x = np.unique(rng.integers(0, 1 << 62, size, dtype=np.uint64))
            change = rng.integers(0, join.most_different(len(x), len(x), percent) + 2)
            y = np.unique(np.concatenate([x[rng.permutation(len(x))[: len(x) - int(rng.integers(0, change + 1))]], rng.integers(0, 1 << 62, int(rng.integers(0, change + 1)), dtype=np.uint64)]))
            common = len(np.intersect1d(x, y))
            if len(y) > len(x):
                x, y = y, x
            if np.array_equal(x, y) or 100 * common < percent * (len(x) + len(y) - common):
                continue
            keys, slots = join.segment_keys(x, percent)
            # Costs are drawn: whatever is left out, a key must remain.
            asks = join.asked(len(x), slots.tolist(), rng.integers(1, 1000, len(keys)).tolist(), percent)
            assert set(keys[np.array(asks)].tolist()) & set(join.segment_keys(y, percent)[0].tolist())


def test_costly_keys_are_left_out():
    x = np.unique(np.random.default_rng(2).integers(0, 1 << 62, 90, dtype=np.uint64))
    keys, slots = join.segment_keys(x)
    held = [2] * len(keys)
    exact = next(i for i, s in enumerate(slots.tolist()) if not s & 1 and s >> join._SIDE == 0 and s >> 1 & 0xFFFF >= join.bands(90)[join.bands_of(len(x), 90)[0]][3])
    held[exact] = 10**6
    assert not join.asked(len(x), slots.tolist(), held)[exact]


# --- 12 -----------------------------------------------------------------------

SPACES = " \t\n\x0b\f\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def brute_repair(rows, changed):
    """By forward costs and whole edit strings; ({conv: result}, {conv: repaired turns})."""
    result, turns_of = {}, {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r[1:] for r in changed if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in mine:
            end = text.rstrip(SPACES)
            faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[1][:1] for r in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        numbers = [r[0] for r in mine if r[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        # State: the last initial; value: cost, edits, turns.
        after = {"": "u", "s": "u", "u": "a", "a": "u"}
        name = {"u": "user", "a": "assistant"}

        def inserted(best):
            best = dict(best)
            for _ in range(3):
                for s, (c, e, t) in list(best.items()):
                    new = c + 5, e + "I", (*t, (name[after[s]], ""))
                    if after[s] not in best or new[:2] < best[after[s]][:2]:
                        best[after[s]] = new
            return best

        best = {"": (0, "", ())}
        for (_, role, text), initial, fault in zip(mine, initials, faults, strict=True):
            step = {}
            for s, (c, e, t) in inserted(best).items():
                options = [(s, (c + 2, e + "D", t))]
                if fault not in ("blank", "duplicate"):
                    extra = 5 * (fault == "truncated")
                    options.append((after[s], (c + 1 + extra, e + "R", (*t, (name[after[s]], text)))))
                    if initial == after[s] or (initial == "s" and s == ""):
                        options.append((initial, (c + extra, e + "K", (*t, (role, text)))))
                for to, new in options:
                    if to not in step or new[:2] < step[to][:2]:
                        step[to] = new
            best = step
        cost, audit, turns = min((v for s, v in inserted(best).items() if s in ("", "a")), key=lambda v: v[:2])
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()
        count = Counter(faults)
        result[conv] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, digest)
        turns_of[conv] = list(turns)
    return result, turns_of


def conversations(long_one):
    rng = random.Random(8)
    said = ["Good.", "Why?", "It ends so", "", "  \n", "!", "Yes. \t", " ", "A long answer " * 50 + "."]
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 12)):
            rows.append((conv, turn + (turn > 4) * 2, rng.choice(["user", "assistant"] * 3 + ["system", "tool", None, "", "süd"]), rng.choice([*said, None, f"One of its own {turn}."])))
    rows += [(None, 0, "user", "Hello."), (None, 1, "assistant", "Hello."), (70, None, "user", "No turn."), (70, None, "user", "No turn."), (70, 3, "assistant", "Well."), (71, 1, "user", "Tie."), (71, 1, "assistant", "Tie."), (71, 1, "user", "Another."), (72, None, None, None)]
    rows += [(80, t, rng.choice(["user", "assistant"]), rng.choice([f"{t}.", f"{t}.", "Once more.", ""])) for t in range(long_one)]
    rng.shuffle(rows)
    return rows


def test_repair_of_damaged(spark):
    rows = conversations(2500)  # more than two chunks
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as code", "'x' as copies", "'y' as conv")
    found = repair.repair_of_damaged(table).collect()
    want, _ = brute_repair(rows, damage(rows))
    assert len(found) == len(want)
    for r in found:
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) == want[r.conv_id], r.conv_id


def test_repaired_turns(spark):
    rows = [r for r in conversations(30) if r[2] is not None and r[3] is not None]
    found = repair.repaired(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("conv_id", "place").collect()
    _, want = brute_repair(rows, rows)
    got = defaultdict(list)
    for r in found:
        got[r.conv_id].append((r.role, r.text))
    assert dict(got) == {c: t for c, t in want.items() if t}


def test_no_conversations(spark):
    assert repair.repair_of_damaged(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_chunks_give_the_edits_of_the_whole():
    rng = random.Random(2)
    for _ in range(500):
        codes = bytes(rng.choice([0, 1, 2, 1, 2, 3, 5, 6, 9, 14, 4]) for _ in range(rng.randint(0, 14)))
        cuts = [0, *sorted(rng.randint(0, len(codes)) for _ in range(3)), len(codes)]
        parts = [codes[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

        def audit(parts):
            ends = [[repair.forward(c, s) for s in repair.STATES] for c in parts]
            cost, states = repair.chosen([[x for c, _ in e for x in c] for e in ends], [[x for _, r in e for x in r] for e in ends])
            return cost, "".join("".join(repair.edits(c, a, b)) for c, a, b in zip(parts, states, states[1:], strict=False)) + "I" * repair.ENDING[states[-1]]

        assert audit(parts) == audit([codes])


# --- 13 -----------------------------------------------------------------------


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    out, forms = {}, {}
    for w in n:
        near = [v for v in n if one_apart(w, v)]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= 10 * n[w]:
            forms[w] = best
        out[w] = len(near)
    rows = set()
    for w in n:
        root = w
        while root in forms:
            root = forms[root]
        rows.add((w, forms.get(w), root, n[w], out[w], n[forms[w]] if w in forms else None))
    return rows


@pytest.mark.parametrize("bucket", [64, 2])
def test_spelling_variants(spark, monkeypatch, bucket):
    monkeypatch.setattr(spelling, "BUCKET", bucket)
    rng = random.Random(3)
    stems = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(7, 12))) for _ in range(12)] + ["abcdefgh", "bcdefgh", "Àbcdefgh", "aaaaaaa", "aaaaaaaa"]
    rows = texts(20)
    for i in range(300):
        words = []
        for _ in range(30):
            w = rng.choice(stems[: 1 + int(len(stems) * rng.random() ** 3)])
            if rng.random() < 0.2:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + "x" + w[at:], w[:at] + "y" + w[at + 1 :], w.upper()])
            words.append(w)
        rows.append((i + 100, rng.choice([" ", ", ", "_"]).join(words)))
    found = spelling.variants(docs(spark, rows, clashing=True).withColumnRenamed("lang", "word").withColumnRenamed("source", "n")).collect()
    want = brute_variants(rows)
    assert len(found) == len(want) and {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in found} == want
    assert any(r.form is not None and r.root != r.form for r in found)


def test_no_words(spark):
    assert spelling.variants(docs(spark, [(1, None), (2, "short words only")])).collect() == []


def test_scan_of_sorted_lists():
    rng = random.Random(1)
    for t in range(200):
        words = sorted({"".join(rng.choice("ab" if t % 2 else "abcd") for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(1, 60))})
        found = spelling.near_pairs(words)
        assert len(found) == len(set(found)) and set(found) == {(i, j) for j in range(len(words)) for i in range(j) if one_apart(words[i], words[j])}
