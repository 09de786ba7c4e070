"""Operators on small activity tables: nulls, empty and long texts, ties, repeated rows, extra columns, brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hindcast.llm.stored import bounded_arrow

public_tokenizers = pytest.importorskip("public_tokenizers")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
EVENT = "event_id long, text string, app string, window string, n int, id string, print string, root string"


@pytest.fixture(scope="module")
def arrow(spark):
    return bounded_arrow(spark)


def events(spark, rows):
    """Rows (event_id, text) with columns that clash with names used inside."""
    return spark.createDataFrame([(i, t, "app", None, 7, "x", "y", None) for i, t in rows], EVENT)


def sentence(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(n))


ODD = [None, "", " ", "\n\n", "a", "é" * 40, "ß́ x▁y  z ", "A" * 30_000, "x\0y", "ok " * 9_000, "🙂 日本"]


def test_token_counts(arrow):
    import sentencepiece

    from hindcast.llm.tokens import count_tokens

    rnd = random.Random(3)
    texts = ODD + ["".join(rnd.choice(["a", "b ", " ", "▁", "\n", "é", "<s>", "  "]) for _ in range(20))
                   for _ in range(200)]
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = count_tokens(events(arrow, [*enumerate(texts), (None, "a b"), (0, "dup")]), PIECES, 100).collect()
    want = Counter((i, len((t or "").encode()), n := len(model.encode(t or "")), n > 100)
                   for i, t in [*enumerate(texts), (None, "a b"), (0, "dup")])
    assert Counter(tuple(r) for r in got) == want
    assert count_tokens(events(arrow, []), PIECES).count() == 0


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    from hindcast.llm.packing import Encoder

    rnd, whole, ours = random.Random(4), Tokenizer.from_file(WORDS), Encoder(WORDS)
    parts = ["a", "B's ", "É", " ", "Σ", "\n", "é", "é", "́", "<|endoftext|>", "İ", ",", ".", "don't", "1",
             "\t", "\x1c", "ﬁ", "ª", "…"]
    for text in [t or "" for t in ODD] + ["".join(rnd.choice(parts) for _ in range(15)) for _ in range(2000)]:
        assert np.frombuffer(ours.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_encoder_with_a_full_memo_equals_the_tokenizer(monkeypatch):
    from tokenizers import Tokenizer

    from hindcast.llm import packing

    monkeypatch.setattr(packing, "MEMO_CHUNKS", 5)
    rnd, whole, ours = random.Random(8), Tokenizer.from_file(WORDS), packing.Encoder(WORDS)
    for text in [t for n in range(40) for t in (sentence(rnd, n), rnd.choice([" ", "", "a.  b,", "\n\nc ", ". , x."]))]:
        assert np.frombuffer(ours.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_packing(arrow):
    from hindcast.llm.packing import pack_best_fit

    rnd = random.Random(5)
    texts = ODD + [sentence(rnd, rnd.randint(0, 60)) for _ in range(150)]
    rows = [r.asDict() for r in pack_best_fit(events(arrow, [*enumerate(texts), (None, "z"), (3, "z")]), WORDS,
                                              capacity=64).collect()]
    by_event = Counter()
    for r in rows:
        by_event[r["event_id"]] += r["length"]
    assert len(by_event) == len(texts) + 1 and all(r["length"] <= 64 for r in rows)
    bins = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == bins.get(r["sequence_id"], 0)
        bins[r["sequence_id"]] = r["offset"] + r["length"]
    total = sum(r["length"] for r in rows)
    assert max(bins.values()) <= 64 and len(bins) <= -(-total // 64) + 1
    assert pack_best_fit(events(arrow, []), WORDS).count() == 0


def many_words(spark, last):
    """One partition: documents of 650,000 different words, more than two full memos, and then one of the text ``last``."""
    words = "transform(sequence(0, 999), i -> translate(cast(id * 1000 + i + 1000000 as string), '0123456789', 'abcdefghij'))"
    return spark.range(0, 651, 1, 1).selectExpr(
        "id as doc_id", f"if(id < 650, array_join({words}, ' '), {f'{last!r}' if last is not None else 'null'}) as text",
        "'en' as lang", "'a' as source", "0L as n_chars")


def test_a_pipeline_document_without_text_comes_after_many_words(arrow):
    from corpus_pipeline import packed

    got = packed(arrow, many_words(arrow, None), "").collect()
    assert {r["doc_id"] for r in got} == set(range(651))
    assert [(r["start"], r["length"]) for r in got if r["doc_id"] == 650] == [(0, 1)]


def test_fullest_is_the_best_sum():
    from itertools import product

    from hindcast.llm.packing import fullest

    rnd = random.Random(6)
    for _ in range(200):
        counts = {rnd.randint(1, 12): rnd.randint(1, 3) for _ in range(rnd.randint(0, 4))}
        room = rnd.randint(0, 30)
        sums = [sum(k * n for k, n in zip(counts, some, strict=True))
                for some in product(*(range(c + 1) for c in counts.values()))]
        taken = fullest(counts, room)
        assert sum(k * n for k, n in taken) == max(s for s in sums if s <= room)
        assert all(n <= counts[k] for k, n in taken)


def test_top_envelopes(arrow):
    from hindcast.llm.topk import top_envelopes

    rnd = np.random.default_rng(7)
    x = [[float(v) for v in row] for row in rnd.normal(size=(300, 13))]
    x[5] = x[6] = x[7]
    rows = [*enumerate(x), (300, None), (301, [1.0, None] + [0.0] * 11), (302, [float("nan")] * 13), (303, []),
            (304, [1.0, 2.0]), (305, [2.0, 1.0]), (None, x[0]), (306, [1e30] * 13)]
    df = arrow.createDataFrame([(i, v, "clash") for i, v in rows], "event_id long, rms array<double>, block string")
    got = {(r["query_id"], r["rank"]): (r["event_id"], r["score"])
           for r in top_envelopes(df, df.filter("event_id % 20 = 0 or event_id in (304, 305)"), 5).collect()}
    whole = {i: [min(max(int(np.floor(256 * c)), -(1 << 31)), (1 << 31) - 1) for c in v] for i, v in rows
             if i is not None and v and all(c is not None and np.isfinite(c) for c in v)}
    want = {}
    for q in [i for i in whole if i % 20 == 0 or i in (304, 305)]:
        best = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(whole[q], v, strict=True)))), i)
                      for i, v in whole.items() if i != q and len(v) == len(whole[q]))[:5]
        want |= {(q, n + 1): (i, -s) for n, (s, i) in enumerate(best)}
    assert got == want
    assert top_envelopes(df.limit(0), df).count() == 0


def families(seed, n=60, words=40):
    """Texts with copies, near copies and passages in common."""
    rnd = random.Random(seed)
    texts = list(ODD)
    for _ in range(n):
        base = sentence(rnd, rnd.randint(3, words)).split()
        for _ in range(rnd.choice([1, 1, 2, 6])):
            other = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 5])):
                other[rnd.randrange(len(other))] = sentence(rnd, 1)
            texts.append(rnd.choice([" ", " ", "\n"]).join(other))
    common = sentence(rnd, 30)
    return texts + [sentence(rnd, 20) + " " + common + " " + sentence(rnd, 20) for _ in range(20)]


def components(sets, links):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(x) for x in range(len(sets))]


def test_ngram_components(arrow):
    from hindcast.llm.ngram_join import ngram_components

    texts = families(8)
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append({tuple(w[k:k + 4]) for k in range(len(w) - 3)} or ({tuple(w)} if w else set()))
    links = [(a, b) for b in range(len(sets)) for a in range(b)
             if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) and sets[a]]
    want = {(i, len(sets[i]), r) for i, r in enumerate(components(sets, links))}
    df = events(arrow, [*enumerate(texts), (12, texts[12]), (None, "a b c d e")])
    got = [tuple(r) for r in ngram_components(df).collect()]
    assert set(got) == want and len(got) == len(want)
    assert ngram_components(events(arrow, [])).count() == 0


def removed(texts, width):
    seen, out = set(), {}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - width + 1):
            if data[s:s + width] in seen:
                gone[s:s + width] = b"\1" * width
            seen.add(data[s:s + width])
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        runs = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out[i] = (len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("seed", [9, 10])
def test_remove_repeats(arrow, seed):
    from hindcast.llm.repeats import remove_repeats

    rnd = random.Random(seed)
    texts = families(seed, 30) + ["ab" * rnd.randint(40, 90) + sentence(rnd, 8) for _ in range(8)]
    texts += ["".join(rnd.choice("ab\0") for _ in range(400)) for _ in range(6)]
    got = {r["event_id"]: tuple(r)[1:] for r in remove_repeats(events(arrow, [*enumerate(texts), (None, texts[-1])]),
                                                               ).collect()}
    assert got.pop(None)[1] == 0
    assert got == removed(texts, 100)
    assert remove_repeats(events(arrow, [])).count() == 0


def test_repeat_groups_are_maximal(arrow):
    from hindcast.llm.repeats import repeat_groups

    rnd = random.Random(11)
    passage = sentence(rnd, 16)[:70]
    texts = [x + passage + y for x, y in zip("pqqr", "uvvw", strict=True)]
    found = {}
    for r in repeat_groups(events(arrow, enumerate(texts)), 40, 16).collect():
        found.setdefault((r["print"], r["reach"], r["length"]), set()).add((r["event_id"], r["start"]))
    raw = [t.encode() for t in texts]
    assert found
    everywhere = set()
    for (_, _, length), places in found.items():
        strings = {raw[i][s:s + length] for i, s in places}
        assert len(strings) == 1 and len(places) > 1
        everywhere.update(i for i, _ in places)
        string = strings.pop()
        assert {(i, s) for i, t in enumerate(raw) for s in range(len(t)) if t.startswith(string, s)} == places
    assert everywhere == {0, 1, 2, 3}


@pytest.mark.parametrize("parts", [1, 3])
def test_repeat_groups_hold_equal_contexts(arrow, parts):
    from hindcast.llm.repeats import repeat_groups

    rnd = random.Random(16)
    passage, copy = sentence(rnd, 40)[:70], sentence(rnd, 40)[:90]
    texts = [x + passage + y for x, y in zip("pqqqqr", "uvvvvw", strict=True)] + [copy] * 5
    found = {}
    df = events(arrow, enumerate(texts)).coalesce(1) if parts == 1 else events(arrow, enumerate(texts)).repartition(parts)
    rows = [tuple(r) for r in repeat_groups(df, 40, 16).collect()]
    for _, _, length, event_id, start in rows:
        found.setdefault(texts[event_id][start:start + length], set()).add((event_id, start))
    assert len(rows) == len(set(rows))
    for string, places in found.items():
        assert places == {(i, s) for i, t in enumerate(texts) for s in range(len(t)) if t.startswith(string, s)}
    assert {i for places in found.values() for i, _ in places} == set(range(len(texts)))


@pytest.mark.parametrize("seed", [17, 18])
def test_hot_anchors_are_split(arrow, seed, monkeypatch):
    from hindcast.llm import repeats

    monkeypatch.setattr(repeats, "BLOCK_ROWS", 6)  # counted on the driver; tasks keep their own
    blocks, by_anchor = [], repeats._by_anchor
    monkeypatch.setattr(repeats, "_by_anchor", lambda rows, *a: (blocks.append(
        max([0, *(r["count"] for r in rows.filter("context is not null").groupBy("print").count().collect())])),
        by_anchor(rows, *a))[1])
    rnd = random.Random(seed)
    gram, common = sentence(rnd, 20)[:40], sentence(rnd, 40)[:150]
    texts = families(seed, 20) + ["ab" * rnd.randint(40, 90) + sentence(rnd, 8) for _ in range(8)]
    for k in range(60):
        ours = rnd.choice([common, common, common[:110], common[40:], gram])
        ends = [rnd.choice(["", "x", "xy", sentence(rnd, 1), sentence(rnd, 20)]) for _ in range(2)]
        texts.append(ends[0] + ours + ends[1])
    df = events(arrow, enumerate(texts)).repartition(5)
    assert {r["event_id"]: tuple(r)[1:] for r in repeats.remove_repeats(df).collect()} == removed(texts, 100)
    assert blocks and blocks[0] < 6


def test_lines(arrow):
    from hindcast.llm.lines import dedup_lines, line_components

    rnd = random.Random(12)
    base = [sentence(rnd, 12) for _ in range(30)]
    texts = [*ODD, *("\n".join(rnd.choice([b, b.upper(), b + rnd.choice(["!", " x", ""])]) for b in rnd.sample(base, 5))
                     for _ in range(25))]
    df = events(arrow, enumerate(texts))
    got = line_components(df).collect()
    lines = [(i, k, n) for i, t in enumerate(texts) for k, n in enumerate((t or "").split("\n"))]
    normal = [n.strip(" \t\r").lower() for _, _, n in lines]
    sets = [{n[j:j + 8] for j in range(max(1, len(n) - 7))} if n else set() for n in normal]
    links = [(a, b) for b in range(len(sets)) for a in range(b)
             if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = {(*lines[x][:2], *lines[r][:2], r == x) for x, r in enumerate(components(sets, links))}
    assert len(got) == len(lines)
    assert len({tuple(r) for r in got} & want) >= 0.99 * len(want)
    kept = {r["event_id"]: r for r in dedup_lines(df).collect()}
    assert set(df.columns) == set(dedup_lines(df).columns)
    assert all(kept[i]["text"] == texts[i] for i in range(4))
    assert sum(len(r["text"].split("\n")) for i, r in kept.items() if i >= len(ODD)) == sum(
        r["kept"] for r in got if r["event_id"] >= len(ODD))
    assert line_components(events(arrow, [])).count() == 0


def test_lines_of_a_group_are_not_all_paired(arrow, monkeypatch):
    """Copies with one word changed are all alike; those with three, twice as many, are like few of them and may come first."""
    from hindcast.llm import lines as L

    rnd = random.Random(14)
    base = sentence(rnd, 70).split()

    def changed(n):
        spots = set(rnd.sample(range(70), n))
        return " ".join("".join(rnd.choices("abcdefgh", k=6)) if i in spots else w for i, w in enumerate(base))

    texts = [changed(1) for _ in range(150)] + [changed(4) for _ in range(450)]
    sets = [{n[j:j + 8] for j in range(len(n) - 7)} for n in texts]
    links = [(a, b) for b in range(len(sets)) for a in range(b) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    asked, plain = {}, L.similar

    def counted(pairs, parities, work, name):
        asked[name] = pairs.count()
        return plain(pairs, parities, work, name)

    monkeypatch.setattr(L, "similar", counted)
    got = {r["event_id"]: r["first_event_id"] for r in L.line_components(events(arrow, enumerate(texts))).collect()}
    want = components(sets, links)
    assert sum(got[i] != r for i, r in enumerate(want)) <= 0.01 * len(want)
    assert len(links) > 11_000 and asked["rest"] < 2 * len(texts) and sum(asked.values()) < 10 * len(texts), asked


def test_lines_joined_by_their_heads_are_not_looked_at_again(arrow, monkeypatch):
    """Parities cost more than a comparison: only lines of bands whose other lines than the head are still apart get any."""
    from hindcast.llm import lines as L

    rnd = random.Random(15)
    base = [sentence(rnd, 40) for _ in range(30)]
    texts = [b + end for b in base for end in ("", " x")] + [base[0] + " y"]
    asked, plain = [], L.with_parities

    def counted(texts):
        asked.append(texts.count())
        return plain(texts)

    monkeypatch.setattr(L, "with_parities", counted)
    got = {r["event_id"]: r["first_event_id"] for r in L.line_components(events(arrow, enumerate(texts))).collect()}
    assert got == {i: 0 if i == len(base) * 2 else i - i % 2 for i in range(len(texts))}
    assert asked == [0]


def test_further_links_join_components(arrow):
    from hindcast.llm.components import connected
    from hindcast.llm.lines import _joined
    from hindcast.llm.stored import Workspace

    links = [[(5, 4), (9, 8), (3, 2)], [(9, 5), (11, 10), (12, 2), (13, 11)], [], [(1, 13), (12, 4)]]
    work = Workspace(arrow, "joined")
    roots = None
    for i in range(len(links)):
        df = arrow.createDataFrame(links[i], "a long, b long")
        roots = (connected(df, work, f"{i}").withColumnRenamed("id", "short") if roots is None
                 else _joined(roots, df, work, f"{i}"))
        every = connected(arrow.createDataFrame(sum(links[:i + 1], []), "a long, b long"), work, f"every-{i}")
        assert sorted(map(tuple, roots.collect())) == sorted(map(tuple, every.collect()))


def test_parities_rule_out_no_like_pair(arrow):
    from hindcast.llm.lines import _side, may_be_alike, with_parities

    rnd = random.Random(13)
    texts = ["ab" * 60, "ab" * 70 + "c", "abcdefg", "abcdefgh"]
    for words in (4, 30, 150, 1500):
        for _ in range(4):
            left = sentence(rnd, words).split()
            texts.append(" ".join(left))
            for share in (0.005, 0.01, 0.02, 0.05, 0.5):
                texts.append(" ".join("zz" if rnd.random() < share else w for w in left))
    sets = [{n[j:j + 8] for j in range(max(1, len(n) - 7))} for n in texts]
    sized = with_parities(arrow.createDataFrame(list(enumerate(texts)), "short long, normal string")).drop("normal").cache()
    assert {r["short"]: r["size"] for r in sized.collect()} == {i: len(x) for i, x in enumerate(sets)}
    pairs = arrow.createDataFrame([(a, b) for b in range(len(texts)) for a in range(b)], "a long, b long")
    left = {tuple(r) for r in pairs.join(_side(sized.withColumnRenamed("short", "a"), "a", "a"), "a")
            .join(_side(sized.withColumnRenamed("short", "b"), "b", "b"), "b").filter(may_be_alike()).select("a", "b").collect()}
    like = {(a, b) for b in range(len(texts)) for a in range(b) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert len(like) > 20 and like <= left
    assert len(left) < 3 * len(like)

def test_tiles():
    from hindcast.llm.tiling import tile

    item = np.arange(1, 21, dtype=np.uint64)
    swapped = np.concatenate((item[10:], [99, 98], item[:10])).astype(np.uint64)
    assert sorted(tile(item, swapped, 5)) == [(0, 12, 10), (10, 0, 10)]
    assert tile(item, item[:4], 5) == []
    twice = np.concatenate((item[:8], [99], item)).astype(np.uint64)
    assert tile(item, twice, 5) == [(0, 9, 20)]
    same = np.ones(12, np.uint64)
    assert sum(t[2] for t in tile(same, same[:7], 5)) == 7


def test_item_coverage(arrow):
    from hindcast.llm.tiling import item_coverage, without_items

    rnd = random.Random(13)
    items = [sentence(rnd, 30) for _ in range(10)] + [None, "", "...", "two words", sentence(rnd, 4)]
    clean = [sentence(rnd, 80) for _ in range(30)]
    half = items[2].split()
    texts = [*ODD, *clean, clean[0] + " " + items[0].upper() + "! " + clean[1],
             " ".join(half[15:]) + ". " + clean[2] + " " + " ".join(half[:15]), " ".join(items[3].split()[:12]),
             clean[3] + " " + items[-1], "some two  words, here"]
    n = len(ODD) + len(clean)
    table = arrow.createDataFrame([(i, t) for i, t in enumerate(items)] + [(None, "x")], "item_id long, text string")
    df = events(arrow, [*enumerate(texts), (n, texts[n]), (None, items[0])])
    got = {(r["event_id"], r["item_id"]): (r["coverage"], r["n_tiles"]) for r in item_coverage(df, table).collect()}
    assert got == {(n, 0): (1.0, 1), (n + 1, 2): (1.0, 2), (n + 3, 14): (1.0, 1), (n + 4, 13): (1.0, 1)}
    assert without_items(df, table).columns == df.columns
    assert item_coverage(events(arrow, []), table).count() == 0
    assert item_coverage(df, table.limit(0)).count() == 0


def test_quality(arrow):
    from hindcast.llm.quality import accepted, score_quality

    rnd = random.Random(14)
    rows, labels = [], []
    for i in range(1200):
        bad = rnd.random() < 0.25
        text = sentence(rnd, 60) + (" vileword " if bad and i % 2 else "") + (" ###" * 9 if bad and not i % 2 else "")
        rows.append((i, text, rnd.choice(["a", "b", None]), rnd.choice(["w", None])))
        labels.append((i, bad))
    rows += [(2000 + k, t, "never", "seen") for k, t in enumerate(ODD)] + [(None, "x", "a", "w")]
    df = arrow.createDataFrame(rows, "event_id long, text string, app string, window string")
    known = arrow.createDataFrame([(i, b) for i, b in labels if i % 3] + [(None, True), (5, None)],
                                  "event_id long, rejected boolean")
    got = {r["event_id"]: r for r in score_quality(df, known).collect()}
    assert len(got) == len(rows)
    held_out = [(i, b) for i, b in labels if i % 3 == 0]
    assert sum(got[i]["rejected"] == b for i, b in held_out) >= 0.98 * len(held_out)
    assert not any(got[2000 + k]["rejected"] for k in range(len(ODD)))
    assert accepted(df, known).columns == df.columns
    assert not score_quality(df, known.limit(0)).filter("rejected").count()
    assert score_quality(df.limit(0), known).count() == 0


def test_places_are_shrunk(arrow):
    from hindcast.llm.quality import score_quality

    rows = [(i, "same words", "big" if i < 400 else "few" if i < 402 else "other", "w") for i in range(800)]
    known = [(i, i % 2 == 0 if i < 400 else i < 402 or i % 10 == 0) for i in range(800)]
    got = {r["event_id"]: r["prior"] for r in score_quality(
        arrow.createDataFrame(rows, "event_id long, text string, app string, window string"),
        arrow.createDataFrame(known, "event_id long, rejected boolean")).collect()}
    assert abs(got[0] - 0.5) < 0.05 and abs(got[700] - 0.1) < 0.05
    assert 0.3 < got[400] < 1.0  # two events, both rejected: between its own share and the others'


def test_reply_trees(arrow):
    from hindcast.llm.replies import format_reply_trees, read_loss, read_turns

    rows = [(1, 1, None, "external", "root <turn>", 1.0), (1, 2, 1, "internal", "a \\b </turn>\n ok", 0.2),
            (1, 3, 1, "internal", "b", 0.9), (1, 4, 3, "external", None, None), (1, 5, 3, None, "c\\", 0.9),
            (2, 1, 9, "internal", "", 1.0), (3, 1, 2, "x", "ring", 1.0), (3, 2, 1, "x", "ring", 1.0),
            (1, 5, 3, None, "c\\", 0.9), (None, 1, None, "x", "y", 1.0), (1, None, 1, "x", "y", 1.0),
            *((4, k, k - 1, "internal", str(k), 0.5) for k in range(1, 300))]
    df = arrow.createDataFrame([(*r, "clash") for r in rows], "thread long, turn_no long, reply_to long, origin string, "
                               "text string, confidence double, steps string")
    out = format_reply_trees(df, best=9)
    got = {(r["thread"], r["leaf"]): ([tuple(t) for t in r["back"]], r["learned"], r["branch"]) for r in out.select(
        "thread", "leaf", "branch", read_turns(F.col("formatted")).alias("back"),
        read_loss(F.col("formatted"), F.col("loss")).alias("learned")).collect()}
    root = ("external", "root <turn>")
    assert got.pop((4, 299)) == ([("internal", str(k)) for k in range(1, 300)], "".join(map(str, range(1, 300))), 1)
    assert got == {(1, 5): ([root, ("internal", "b"), ("", "c\\")], "b", 1),
                   (1, 4): ([root, ("internal", "b"), ("external", "")], "b", 2),
                   (1, 2): ([root, ("internal", "a \\b </turn>\n ok")], "a \\b </turn>\n ok", 3),
                   (2, 1): ([("internal", "")], "", 1)}
    assert format_reply_trees(df).count() == 3
    assert format_reply_trees(df.limit(0)).count() == 0


def test_secrets(arrow):
    from hindcast.llm.secret_links import find_secrets

    key = "AKIA" + "Q7" * 8
    bare = "wJalrXUtnFEMI/K7MDENG/bPxRfi"
    texts = [*ODD, f"password = 'hunter2hunter2' 🙂 {key} token: abc", "secret: token: abcdefghij",
             f"login={'bob_smith'} at https://host.example/x then {bare} end", f"{bare} alone", f"{key} near {bare} only",
             "0" * 31 + " " + "f" * 32, f"user: someone {'x ' * 300} https://far.example/y {bare}"]
    got = {r["event_id"]: r for r in find_secrets(events(arrow, [*enumerate(texts), (None, "api_key=12345678")])).collect()}
    n = len(ODD)

    def kinds(i):
        text = texts[i]
        return [(s["kind"], text[s["start"]:s["stop"]]) for s in got[i]["spans"]]
    assert all(not got[i]["spans"] for i in range(n))
    assert kinds(n) == [("assign", "password = 'hunter2hunter2"), ("access", key)]
    assert kinds(n + 1) == []
    assert kinds(n + 2) == [("login", "login=bob_smith"), ("endpoint", "https://host.example/x"), ("bare", bare)]
    assert kinds(n + 3) == [] and kinds(n + 4) == [("access", key)] and kinds(n + 6) == []
    assert kinds(n + 5) == [("hex", "f" * 32)]
    assert got[None]["n_assign"] == 1 and len(got) == len(texts) + 1
    assert find_secrets(events(arrow, [])).count() == 0


def test_components_of_chains(arrow):
    from hindcast.llm.components import connected
    from hindcast.llm.stored import Workspace

    rnd = random.Random(15)
    names = rnd.sample(range(1000), 300)
    links = [(names[k], names[k + 1]) for k in range(299) if k != 150] + [(5000, 5000)]
    got = {r["id"]: r["root"] for r in connected(arrow.createDataFrame(links, "a long, b long"),
                                                 Workspace(arrow, "test")).collect()}
    assert got == dict.fromkeys(names[:151], min(names[:151])) | dict.fromkeys(names[151:], min(names[151:]))
