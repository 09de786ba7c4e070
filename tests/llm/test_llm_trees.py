"""BPE trees, the Merkle manifest and periodic runs: against the library, brute force and odd tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import SMALL
from hindcast.llm.stored import bounded_arrow
from hindcast.session import configure

public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS = public_tokenizers.path("word_bpe_49k.json")
EVENT = "event_id long, text string, app string, window string, text_len int, id string, tree string, digest string, kept int"
ODD = [None, "", " ", "\n\n", "a", "é" * 40, "ß́ x▁y  z ", "A" * 30_000, "x\0y", "ok " * 9_000, "🙂 日本",
       "<|endoftext|> a <|startof", "'ll " * 99]


@pytest.fixture(scope="module")
def arrow(spark):
    return bounded_arrow(configure(spark))


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").collect()


def events(spark, rows):
    """Rows (event_id, text[, app]) with columns that clash with names used inside."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "app", None, 7, "x", "y", "z", 3)
                                  for r in rows], EVENT)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


# BPE trees

@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS)


def cut_up(encoder, text, leaf):
    from hindcast.llm.bpe_trees import Node

    if len(text) <= leaf:
        return [Node.leaf(encoder, text)]
    cut = len(text) // 2
    return cut_up(encoder, text[:cut], leaf) + cut_up(encoder, text[cut:], leaf)


@pytest.mark.parametrize(("window", "edge"), [(24, 1024), (128, 1024), (20, 30), (20, 120)])
def test_trees_equal_the_library_wherever_the_cuts_fall(library, monkeypatch, window, edge):
    from hindcast.llm import bpe_trees
    from hindcast.llm.packing import Encoder

    monkeypatch.setattr(bpe_trees, "WINDOW_CHARS", window)
    monkeypatch.setattr(bpe_trees, "EDGE_CHARS", edge)
    rnd, whole, encoder = random.Random(window + edge), 0, Encoder.of(WORDS)
    parts = ["a", "B's ", "É", " ", "Σ", "\n", "é", "́", "̣", "<|endoftext|>", "<|startoftext|>", "<|endof",
             "İ", ",", ".", "don't", "1", "\t", "\x1c", "ﬁ", "ª", "…", "日本語", "🙂", "'ve", "'", "ll", "the", "ing",
             "각", "ᄀ", "ᅡ", "ー"]
    for _ in range(300):
        some = rnd.sample(parts, rnd.randint(1, 8))
        text = "".join(rnd.choice(some) for _ in range(rnd.randint(1, 400)))
        want = library.encode(text, add_special_tokens=False).ids
        tree = bpe_trees.join_tree(library, cut_up(encoder, text, rnd.choice([20, 40, 100, 300])))
        whole += tree is not None
        assert tree is None or tree.ids().tolist() == want, text
    assert whole > (290 if edge == 1024 else 60)


def test_texts_are_encoded_and_decoded_as_by_the_library(arrow, library):
    from hindcast.llm.bpe_trees import decoded, encode_texts

    rnd = random.Random(9)
    unsplit = "".join(rnd.choice("abcdefghij") for _ in range(5_000))
    rows = [*enumerate([*ODD, unsplit, "日本語" * 700]), (None, unsplit), (0, "dup"), (0, "dup")]
    ids = encode_texts(events(arrow, rows), WORDS, leaf_chars=300, decode=True)
    got = Counter((r["event_id"], tuple(r["ids"]), r["decoded"]) for r in ids.collect())
    want = Counter()
    for event_id, text in rows:
        found = library.encode(text or "", add_special_tokens=False).ids
        want[event_id, tuple(found), library.decode(found, skip_special_tokens=False)] += 1
    assert got == want
    apart = encode_texts(events(arrow, rows[:20]), WORDS, 300).select("*", decoded(F.col("ids"), WORDS).alias("back"))
    assert {(r["event_id"], tuple(r["ids"]), r["back"]) for r in apart.collect()} <= set(want)
    assert encode_texts(events(arrow, []), WORDS).count() == 0


def test_a_text_with_empty_chunks_comes_after_many_words(arrow, library):
    """One partition: texts of 650,000 different words, more than two full memos, and then odd ones."""
    from hindcast.llm.bpe_trees import encode_texts

    words = "transform(sequence(0, 999), i -> translate(cast(id * 1000 + i + 1000000 as string), '0123456789', 'abcdefghij'))"
    odd = {650: None, 651: "", 652: "a  b\n\nc"}
    texts = arrow.range(0, 653, 1, 1).selectExpr(
        "id as event_id", f"case id when 650 then null when 651 then '' when 652 then 'a  b\\n\\nc' else array_join({words}, ' ') end as text")
    got = {r["event_id"]: r["ids"] for r in encode_texts(texts, WORDS).filter("event_id >= 649").collect()}
    assert len(got) == 4
    assert {i: got[i] for i in odd} == {i: library.encode(t or "", add_special_tokens=False).ids for i, t in odd.items()}


def test_readers_of_whole_texts_get_few_of_them_at_once(arrow, monkeypatch):
    """A reader takes up to 4,096 rows at once, but none of the next row group."""
    from pyspark.sql.types import ArrayType

    from hindcast.llm import bpe_trees
    from hindcast.llm.stored import Workspace

    seen, saved = [], Workspace.saved

    def watched(self, *args):
        seen.append(saved(self, *args))
        return seen[-1]

    monkeypatch.setattr(bpe_trees, "GROUP_BYTES", 64 << 10, raising=False)
    monkeypatch.setattr(Workspace, "saved", watched)
    rnd = random.Random(12)
    texts = ["".join(rnd.choice("abcdefghij ") for _ in range(20_000)) for _ in range(60)]
    assert bpe_trees.encode_texts(events(arrow, enumerate(texts)).coalesce(1), WORDS, 10_000).count() == 60
    files = [f for t in seen if any(isinstance(c.dataType, ArrayType) for c in t.schema) for f in t.inputFiles()]
    held = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in files]
    assert sum(m.num_rows for m in held) == 60
    assert max(m.row_group(k).num_rows for m in held for k in range(m.num_row_groups)) <= 8


def test_bpe_query_equals_the_library(arrow, library, documents):
    got = {r["doc_id"]: tuple(r)[1:] for r in entry.queries()["op11_bpe_trees"](arrow, SMALL).collect()}
    for r in documents:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert got[r["doc_id"]] == (len(ids), sha(" ".join(map(str, ids))),
                                    sha(library.decode(ids, skip_special_tokens=False)))


# Merkle manifest

def joint(*fields):
    return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def proven(digests):
    """Root of a list of digests and for each the steps (left, right) to it."""
    if len(digests) == 1:
        return digests[0], [[]]
    runs = [digests[i:i + 16] for i in range(0, len(digests), 16)]
    root, above = proven([sha("".join(r)) for r in runs])
    return root, [[("".join(r[:k]), "".join(r[k + 1:])), *above[i]] for i, r in enumerate(runs) for k in range(len(r))]


def brute_manifest(rows):
    """rows: (group, id, leaf) -> Counter of (id, leaf, subroot, root, steps)."""
    groups = defaultdict(list)
    for group, ident, leaf in rows:
        groups[group].append((ident is not None, ident or 0, leaf, ident))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    own = {g: proven([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order}
    root, tops = proven([own[g][0] for g in order]) if order else (None, [])
    return Counter((x[3], x[2], own[g][0], root, tuple(steps + top)) for g, top in zip(order, tops, strict=True)
                   for x, steps in zip(sorted(groups[g], key=lambda x: x[:3]), own[g][1], strict=True))


@pytest.mark.parametrize("few", [None, 1])
def test_manifest_equals_brute_force(arrow, monkeypatch, few):
    from hindcast.llm import merkle

    if few is not None:
        monkeypatch.setattr(merkle, "BROADCAST_RUNS", few)
    rnd = random.Random(2)
    rows = ([(i, rnd.choice(["t", None, "", "é"]), "hot") for i in range(700)] + [(7, "only", "lone"), (None, "x", None)]
            + [(5, "same", "pair"), (5, "same", "pair"), (5, "other", "pair"), (None, None, "pair"), (1, "", "")]
            + [(i, "t", f"app{i % 20}") for i in range(60)])
    got = merkle.manifest(events(arrow, rows), keep=["kept"]).collect()
    want = brute_manifest([(app, i, joint(i, app, None, 7, text)) for i, text, app in rows])
    assert Counter((r["event_id"], r["leaf"], r["subroot"], r["root"],
                    tuple((s["left"], s["right"]) for s in r["proof"])) for r in got) == want
    assert {r["kept"] for r in got} == {3}


def test_manifest_of_odd_tables(arrow):
    from hindcast.llm.merkle import fold, manifest

    assert manifest(events(arrow, [])).count() == 0
    lone = manifest(events(arrow, [(1, "a")])).select("*", fold(F.col("leaf"), F.col("proof")).alias("back")).collect()
    assert [(r["leaf"], r["subroot"], r["root"], r["proof"], r["back"]) for r in lone] == [(joint(1, "app", None, 7, "a"),) * 3
                                                                                         + ([], joint(1, "app", None, 7, "a"))]
    with pytest.raises(ValueError):
        manifest(events(arrow, []), keep=["event_id", "root"])


def test_manifest_query_equals_brute_force(arrow, documents):
    leaf = {r["doc_id"]: joint(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in documents}
    want = {i: rest for i, *rest in brute_manifest([(r["source"], r["doc_id"], leaf[r["doc_id"]]) for r in documents])}
    text = {r["doc_id"]: r for r in documents}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    seen = entry.queries()["op12_merkle_manifest"](arrow, SMALL).collect()
    assert len(seen) == len(documents)
    for r in seen:
        own, subroot, root, steps = want[r["doc_id"]]
        d, h = text[r["doc_id"]], own
        if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0:
            h = joint(d["doc_id"], d["source"], d["lang"], d["n_chars"], d["text"] and d["text"].translate(lower))
        for left, right in steps:
            h = sha(left + h + right)
        assert tuple(r) == (r["doc_id"], own, subroot, root, sha("".join(a + b for a, b in steps)), h, h == root)


# Periodic runs

def brute_runs(w, least, power):
    """By scanning each period; a stretch that has a smaller period is not of that one."""
    n, out = len(w), []
    for q in range(1, n // power + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, power * q):
                whole = w[i:j + q]
                if not any(whole[d:] == whole[:-d] for d in range(1, q)):
                    out.append((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def test_periodic_runs_equal_brute_force(arrow):
    from hindcast.llm.periodic import periodic_runs

    rnd = random.Random(1)
    texts = list(ODD)
    for _ in range(300):
        parts = []
        for _ in range(rnd.randint(1, 5)):
            if rnd.random() < .5:
                unit = [rnd.choice("ab" if rnd.random() < .7 else "abcdefgh") for _ in range(rnd.randint(1, 9))]
                parts += (unit * rnd.randint(1, 14))[:rnd.randint(1, 90)]
            else:
                parts += [rnd.choice("abcdefghijkl") for _ in range(rnd.randint(0, 20))]
        texts.append(rnd.choice([" ", "\n", " \t "]).join(parts))
    rows = [*enumerate(texts), (None, "x y " * 20), (0, "dup"), (0, "dup")]
    for least, power in ((24, 3), (6, 2), (30, 2)):
        got = Counter((r["event_id"], r["n_words"], tuple(map(tuple, r["runs"])), r["collapsed"])
                      for r in periodic_runs(events(arrow, rows), least, power).collect())
        want = Counter()
        for event_id, text in rows:
            w = words(text or "")
            if len(set(w)) == 1 and len(w) > 1000:
                runs = [(0, len(w), 1)]
            else:
                runs = brute_runs(w, least, power)
            want[event_id, len(w), tuple(runs), collapsed(w, runs)] += 1
        assert got == want
    assert periodic_runs(events(arrow, [])).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(events(arrow, []), 24, 1)


def test_periodic_query_equals_brute_force(arrow, documents):
    got = {r["doc_id"]: tuple(r)[1:] for r in entry.queries()["op13_periodic_runs"](arrow, SMALL).collect()}
    found = 0
    for r in documents:
        w, h = words(r["text"] or ""), zlib.crc32(str(r["doc_id"]).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        elif len(w) > 2000:
            continue  # brute force is quadratic; the altered ones are all compared
        runs = brute_runs(w, 24, 3)
        best = None
        for run in runs:
            if best is None or run[1] * best[2] > best[1] * run[2]:
                best = run
        one = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
        listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        assert got[r["doc_id"]] == (len(runs), *one, sha(listed), sha(collapsed(w, runs)))
        found += len(runs)
    assert len(got) == len(documents) and found > 0
