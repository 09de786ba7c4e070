"""Registered queries and the pipeline's stages on the smallest tables, against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from conftest import SMALL
from hindcast.llm.stored import Workspace
from hindcast.session import configure

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def run(spark):
    return lambda name: [r.asDict() for r in entry.queries()[name](configure(spark), SMALL).collect()]


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def linked(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x
    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(x) for x in range(n)]


def similar(sets, percent):
    """All pairs of sets that have ``percent`` of their union in common, by counting."""
    holders, shared = defaultdict(list), Counter()
    for i, s in enumerate(sets):
        for g in s:
            shared.update((j, i) for j in holders[g])
            holders[g].append(i)
    return [(a, b) for (a, b), n in shared.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]


def line_firsts(texts):
    """The first line of each line's component, where blank lines stand alone."""
    places = defaultdict(list)
    out = {}
    for i in sorted(texts):
        for k, line in enumerate(texts[i].split("\n")):
            normal = line.strip(" \t\r").lower()
            out[i, k] = (i, k)
            if normal:
                places[normal].append((i, k))
    names = list(places)
    sets = [{n[j:j + 8] for j in range(max(1, len(n) - 7))} for n in names]
    first = {}
    roots = linked(len(names), similar(sets, 80))
    for name, r in zip(names, roots, strict=True):
        first[r] = min(first.get(r, places[name][0]), places[name][0])
    for name, r in zip(names, roots, strict=True):
        out |= dict.fromkeys(places[name], first[r])
    return out


def gram_components(texts):
    ids = sorted(texts)
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for i in ids:
        w = re.findall(r"[^\x20\x09-\x0D]+", texts[i].translate(low))
        sets.append({tuple(w[k:k + 4]) for k in range(len(w) - 3)} or ({tuple(w)} if w else set()))
    return {i: ids[r] for i, r in zip(ids, linked(len(ids), similar(sets, 85)), strict=True)}


def tokens(text):
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
    return re.findall(rb"[0-9a-z\x80-\xff]+", low)


def covered(item, text, least):
    """Greedy tiling by trying every place in every round."""
    item_free, text_free, total = [True] * len(item), [True] * len(text), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while (i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n]
                       and item_free[i + n] and text_free[j + n]):
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < least or not n:
            return total
        item_free[i:i + n] = text_free[j:j + n] = [False] * n
        total += n


def held(texts, items):
    """(document, item) of half covered items; only pairs with a five-token run in common are tiled."""
    out = set()
    for m, item in items.items():
        item = tokens(item)
        least = min(5, len(item))
        seeds = {tuple(item[k:k + least]) for k in range(len(item) - least + 1)} if item else set()
        for i, text in texts.items():
            text = tokens(text)
            if any(tuple(text[k:k + least]) in seeds for k in range(len(text) - least + 1)):
                if covered(item, text, least) >= 0.5 * len(item):
                    out.add((i, m))
    return out


def check_packing(rows, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, total = {}, 0
    for i, text in texts.items():
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        total += len(ids)
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at:at + 4096]
            want[i, piece] = (at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    ends = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 4096 and len(ends) <= -(-total // 4096) + 1


def test_op1(run, texts):
    got = {(r["doc_id"], r["line_no"]): (r["first_doc_id"], r["first_line_no"]) for r in run("op1_line_dedup")}
    want = line_firsts(texts)
    assert set(got) == set(want)
    assert sum(got[k] != want[k] for k in want) <= 0.01 * len(want)


def test_op2(run, texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {i: (len(t.encode()), n := len(model.encode(t)), n > 4096) for i, t in texts.items()}
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in run("op2_token_counts")} == want


def test_op5_agrees_with_labels_it_has_not_seen(spark):
    """Fitted on two of three labels; a handful of labels, as in the smallest tables, rejects nothing."""
    from hindcast.llm.quality import score_quality
    from hindcast.llm.queries import documents, events_of, rejections
    from hindcast.llm.stored import bounded_arrow

    larger = SMALL.replace("0.001", "0.1")
    labels = bounded_arrow(configure(spark)).read.parquet(f"{larger}/labels.parquet")
    scored = score_quality(events_of(documents(spark, larger)), rejections(labels.filter("doc_id % 3 > 0")))
    got = {r["event_id"]: r["rejected"] for r in scored.collect()}
    unseen = labels.filter("doc_id % 3 = 0").collect()
    clean = [got[r["doc_id"]] for r in unseen if r["quality"] == 1 and r["toxic"] == 0]
    bad = [got[r["doc_id"]] for r in unseen if r["quality"] == 0 or r["toxic"] == 1]
    assert len(got) == 10_000 and sum(clean) <= 0.01 * len(clean) and sum(bad) >= 0.88 * len(bad)


def test_op6(run, texts):
    check_packing(run("op6_best_fit_packing"), texts)


def test_op8(run, spark, texts):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    assert {(r["doc_id"], r["item_id"]) for r in run("op8_benchmark_tiling")} == held(texts, items)


def test_op9(run, texts):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                        re.I | re.A)
    want = {}
    for i, text in texts.items():
        spans = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m[2]) >= 8]
        spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
        spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
        said = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(spans))
        want[i] = (*(sum(s[1] == k for s in spans) for k in range(3)), hashlib.sha256(said.encode()).hexdigest())
    assert {r["doc_id"]: (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"])
            for r in run("op9_secret_links")} == want


def test_op10(run, texts):
    seen, want = set(), {}
    for i in sorted(texts):
        data = texts[i].encode()
        gone = bytearray(len(data))
        for s in range(len(data) - 99):
            if data[s:s + 100] in seen:
                gone[s:s + 100] = b"\1" * 100
            seen.add(data[s:s + 100])
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        want[i] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])
            for r in run("op10_repeated_passages")} == want


def test_pipeline_stages(spark, texts):
    work = Workspace(configure(spark), "stages")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_copies", "decontaminated", "packed"]
    left = texts
    for name, stage in corpus_pipeline.STAGES:
        out = work.saved(stage(spark, docs, SMALL), name)
        if name != "packed":
            assert out.columns == docs.columns
            now = {r["doc_id"]: r["text"] or "" for r in out.collect()}
        if name == "quality":
            assert 0.7 * len(left) < len(now) and all(left[i] == t for i, t in now.items())
        if name == "lines":
            first = line_firsts(left)
            want = {i: "\n".join(line for k, line in enumerate(t.split("\n")) if first[i, k] == (i, k))
                    for i, t in left.items()}
            want = {i: t for i, t in want.items() if t.strip() or t == left[i]}
            assert sum(now.get(i) != t for i, t in want.items()) <= 0.02 * len(want)
            assert all(r["n_chars"] == len(r["text"]) for r in out.collect())
        if name == "near_copies":
            roots = gram_components(left)
            assert now == {i: t for i, t in left.items() if roots[i] == i}
        if name == "decontaminated":
            gone = {i for i, _ in held(left, items)}
            assert gone and now == {i: t for i, t in left.items() if i not in gone}
        if name == "packed":
            check_packing([r.asDict() for r in out.collect()], left)
        docs, left = out, now


def test_pipeline_runs_its_stages(spark):
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert corpus_pipeline.run(configure(spark), SMALL).count() > 100


def test_near_copies_by_five_words(spark):
    """Stage near_copies links at a five-word similarity of 0.8; op4 keeps its four words and 85 %."""
    from hindcast.llm.ngram_join import ngram_components

    rnd = np.random.default_rng(21)

    def said(n):
        return [f"w{k}" for k in rnd.integers(0, 10**9, n)]
    rows = {}
    for k, (replaced, added) in enumerate([(44, 0), (0, 110), (60, 0), (0, 140), (20, 0)]):
        base = said(500)
        rows[10 * k] = base
        rows[10 * k + 1] = base[:200] + said(replaced) + base[200 + replaced:] + said(added)
    rows |= {100: said(3), 101: [], 102: said(700)}
    ids = sorted(rows)
    sets = [{tuple(w[j:j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set()) for w in map(rows.get, ids)]
    roots = linked(len(ids), similar(sets, 80))
    want = {i for k, i in enumerate(ids) if roots[k] == k}
    assert want == set(ids) - {1, 11, 41}
    docs = configure(spark).createDataFrame([(i, " ".join(w), "en", "web", len(" ".join(w))) for i, w in rows.items()],
                                            "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, SMALL).collect()} == want
    events = docs.withColumnRenamed("doc_id", "event_id")
    assert ngram_components(events).filter("component_id <> event_id").collect()[0]["event_id"] == 41
