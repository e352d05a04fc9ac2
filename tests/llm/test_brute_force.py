"""Each operator against a plain, single-machine version over whole small tables, with edge rows added."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from wavelake.llm import chat, context_tree, decontaminate, nn_descent, pieces, queries, secret_scan, simhash, token_counts, toxicity, warc

LONG = "lorem " * 60_000 + "x" * 50_000 + " ende"
EDGE = [(9001, None), (9002, ""), (9003, "   \t\n "), (9004, LONG), (9005, "Ünï ▁marker  double <s> </s> <unk>\0tab\tend "), (9006, "same same"), (9006, "same same"), (None, "no id here")]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def with_edges(spark, small):
    """documents and the edge rows, in a folder of their own under columns that clash with the operators' own."""
    own = spark.read.parquet(f"{small}/documents.parquet")
    extra = spark.createDataFrame([(i, t, "xx", f"s{n}", 0) for n, (i, t) in enumerate(EDGE)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    clash = own.unionByName(extra.select(*(F.col(c).cast(own.schema[c].dataType) for c in own.columns)))
    return clash.withColumns({c: F.lit(1) for c in ("row_", "spans", "base", "kept", "toxicity", "rep", "f0", "block", "ids", "node", "n")})


@pytest.fixture(scope="module")
def documents(spark, small):
    docs = with_edges(spark, small).cache()
    docs.count()
    return docs


@pytest.fixture(scope="module")
def plain(documents):
    return [(r.doc_id, r.text or "", r.source) for r in documents.select("doc_id", "text", "source").collect()]


def words10(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_op1(spark, small, documents, plain, monkeypatch):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()] + [(7777, "same"), (7778, None), (7779, "")]
    where = defaultdict(set)
    for i, t in items:
        ws = words10(t)
        for k in range(max(1, len(ws) - 9) if ws else 0):
            where[tuple(ws[k : k + 10])].add(str(i))
    sizes = {len(w) for w in where}
    want = []
    for i, t, _ in plain:
        ws, hit, found = words10(t), set(), set()
        for n in sizes:
            for k in range(len(ws) - n + 1):
                if tuple(ws[k : k + n]) in where:
                    hit.update(range(k, k + n))
                    found |= where[tuple(ws[k : k + n])]
        want.append((i, len(ws), len(hit), tuple(sorted(found))))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    for block in (1 << 20, 3000):  # one block, several blocks
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
        got = [(r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in decontaminate.contamination(documents, bench).collect()]
        assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(w[2] > 0 for w in want) > 3
    assert {r.n_hit for r in decontaminate.contamination(documents, bench.limit(0)).collect()} == {0}
    assert decontaminate.contamination(documents.limit(0), bench).count() == 0


def test_op1_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x x beta x gamma"), (2, "alpha " + "x " * 30 + "beta gamma")], "doc_id bigint, text string")
    asked = spark.createDataFrame([(5, "Alpha beta gamma")], "item_id bigint, text string")
    index = decontaminate.build_index(docs)
    assert [(r.item_id, r.doc_id) for r in decontaminate.proximity_matches(index, asked, 5).collect()] == [(5, 1)]


def test_op2(documents, plain):
    vocabulary = pieces.load_vocabulary(pieces.default_model())
    rows = pieces.decode(pieces.encode(documents.select("doc_id", "text"))).collect()
    assert len(rows) == len(plain)
    for r in rows:
        text = r.text or ""
        assert r.decoded == text.replace("▁", " ")
        if len(text) < 4000:
            marked = b" " + text.replace("▁", " ").encode() if text else b""
            ids, lengths = vocabulary.best_path(marked)
            by_word = b"".join(vocabulary.spelled(*vocabulary.best_path(b" " + w), b" " + w) for w in pieces.pre_tokens(text.encode()))
            assert np.frombuffer(by_word, np.int32).tolist() == list(r.ids)
            cost = lambda own: sum(vocabulary.scores[i] if i != vocabulary.unknown else vocabulary.unknown_score for i in own)
            cut = [i for w in pieces.pre_tokens(text.encode()) for i in vocabulary.best_path(b" " + w)[0]]
            assert math.isclose(cost(ids), cost(cut), abs_tol=1e-6)  # the best path of the whole text at once


def test_op2_viterbi_is_best():
    """All segmentations of short words by enumeration."""
    v = pieces.load_vocabulary(pieces.default_model())
    table = {p: v.scores[i] for i, p in enumerate(v.text_of) if v.kinds[i] == pieces.NORMAL}
    for word in (b" tokens", b" a,b", b" running", b" 2024x"):
        best = max(sum(table[w] for w in cut) for k in range(len(word)) for at in itertools.combinations(range(1, len(word)), k) if all((w := word[a:b]) in table for a, b in zip((0, *at), (*at, len(word)))) for cut in [[word[a:b] for a, b in zip((0, *at), (*at, len(word)))]])
        ids, _ = v.best_path(word)
        assert math.isclose(sum(v.scores[i] for i in ids), best)


def test_op3(documents, plain):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(documents).collect())
    counts = {t: len(library.encode(t)) for _, t, _ in plain}
    assert got == Counter((i, len(t.encode()), counts[t], counts[t] > 4096) for i, t, _ in plain)


def base_spans(text):
    out = []
    for m in re.finditer(r"""(?:(?i:password|passwd|secret|token)|(?i:api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII):
        if len(m[1]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


SECRETS = [(1, "token: abcdef123456 and AKIA" + "A1" * 8 + " é " + "0f" * 13, "a"), (2, "x TOKEN = 'abcdef123456' y", "b"), (3, "token=abcdef123456", "c"), (4, "key sk_LIVE-abcdefghij0123456789ABCD end", "a"), (5, "secret:abc", "a"), (6, None, None), (7, "apiKey='abcdef123456'apikey:zzzzzz", None)]


def test_op4(spark, documents, plain):
    docs = documents.select("doc_id", "text", "source").unionByName(spark.createDataFrame([(i + 10**6, t, s) for i, t, s in SECRETS], "doc_id bigint, text string, source string"))
    rows = secret_scan.secret_report(docs).collect()
    want = Counter()
    for i, t, _ in [*plain, *((i + 10**6, t or "", s) for i, t, s in SECRETS)]:
        b = base_spans(t)
        want[(i, *(sum(x[1] == k for x in b) for k in range(3)), sha(",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in b)))] += 1
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in rows) == want
    spans = {r.doc_id: r for r in rows}
    assert spans[10**6 + 4].spans == "owner:4:36" and spans[10**6 + 4].n_live == 1
    assert spans[10**6 + 2].n_example == 1 and spans[10**6 + 1].n_live == 2


def test_op4_redact(spark, documents):
    docs = spark.createDataFrame(SECRETS, "doc_id bigint, text string, source string").withColumns({c: F.lit(c) for c in ("row_", "spans", "kept", "owner_", "base")})
    out = {r.doc_id: r for r in secret_scan.redact(docs).collect()}
    assert len(out) == len(SECRETS) and out[6].text is None and out[6].kept == "kept"
    assert out[4].text == "key [SECRET] end" and out[3].text == SECRETS[2][1] and "[SECRET] é [SECRET]" in out[1].text
    assert secret_scan.redact(documents.limit(0)).count() == 0


def test_op5(spark, small):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{small}/conversations.parquet").collect()]
    said = "\\### Assistant: </turn> ok"
    nasty = "<|end|>\n\\<|assistant|> |> \\\\ $1"
    rows += [(-7, 0, "user", said), (-7, 1, "assistant", said), (-8, 0, "system", nasty), (-8, 1, None, None), (-8, 2, "assistant", nasty), (-8, 2, "assistant", nasty), (-9, 0, "assistant", "w " * 5000), (-9, 1, "user", "hm"), (-9, 2, "assistant", "w " * 900), (None, 0, "user", "x")]
    rows += [(-10, i, ("user", "assistant")[i % 2], f"turn {i} " * 40) for i in range(200)]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: r for r in chat.chat_report(table).collect()}
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t, r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        learnt = "".join(x for _, r, x in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(learnt), sha(learnt)), c
    assert got[-10].n_windows > 5 and chat.chat_report(table.limit(0)).count() == 0


def prints(text):
    ws = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
    if not ws:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(ws[i : i + 3]).encode(), 42) for i in range(max(1, len(ws) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_op6(documents, plain):
    fs = {(i, t): prints(t) for i, t, _ in plain if i is not None and len(t) < 10**5}
    distinct = sorted(set(fs.values()))
    first = {f: min(i for (i, _), g in fs.items() if g == f) for f in distinct}
    comp = components(first.values(), [(first[a], first[b]) for a, b in itertools.combinations(distinct, 2) if (a ^ b).bit_count() <= 2])
    own = documents.where("doc_id IS NOT NULL AND length(coalesce(text, '')) < 100000")
    got = Counter((r.doc_id, r.f & (1 << 64) - 1, r.component_id) for r in simhash.fingerprint_components(own).collect())
    assert got == Counter((i, fs[i, t], comp[first[fs[i, t]]]) for i, t, _ in plain if (i, t) in fs)


@pytest.mark.parametrize("free", [64, 13])
def test_op6_links_are_whole(spark, free):
    """Scattered families, and one family of fingerprints that differ in a few bits only, far more than a list could hold as pairs."""
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(0, 1 << 62, 20 if free == 64 else 2)]
    fs = {b ^ sum(1 << int(k) for k in rng.choice(free, n, replace=False)) for b in base for n in (0, 1, 1, 2, 2, 3, *([3, 4, 5] * (free < 64))) for _ in range(6 if free == 64 else 60)}
    fs = sorted({simhash.signed(f) for f in fs})
    links = simhash.fingerprint_links(spark.createDataFrame([(f, i) for i, f in enumerate(fs)], "f bigint, rep bigint"))
    got = {(min(r.a, r.b), max(r.a, r.b)) for r in links.collect()}
    assert got == {(i, j) for i, j in itertools.combinations(range(len(fs)), 2) if ((fs[i] ^ fs[j]) & (1 << 64) - 1).bit_count() <= 2}


def shingles5(text):
    ws = text.lower().split()
    return frozenset(" ".join(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))) if ws else frozenset()


def test_near_duplicate_groups(spark, documents, plain):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(3000)]
    made, n = [], 20_000
    for family in range(6):  # families larger than a sample's whole pairs, with chains away from the first text
        text = list(rng.choice(words, 150))
        for _ in range(40):
            text = list(text)
            text[int(rng.integers(150))] = f"c{n}"
            made.append((n, " ".join(text)))
            n += 1
    core = list(rng.choice(words, 60))
    for k in range(160):  # copies of a text that is itself there or not, most of them near the threshold to it and to each other
        text = list(core)
        for at in rng.choice(60, int(rng.integers(0, 3)), replace=False):
            text[at] = f"d{int(rng.integers(40))}"
        made.append((n + k, " ".join(text[int(rng.integers(3)) :])))
    docs = documents.select("doc_id", "text").where("length(coalesce(text, '')) < 100000").unionByName(spark.createDataFrame(made, "doc_id bigint, text string"))
    rows = [(r.doc_id, r.text or "") for r in docs.where("doc_id IS NOT NULL").collect()]
    sets = defaultdict(list)
    for i, t in rows:
        sets[" ".join(t.lower().split())].append(i)
    rep = {k: min(v) for k, v in sets.items()}
    grams = {r: shingles5(k) for k, r in rep.items()}
    by = defaultdict(list)
    for r, g in grams.items():
        for x in g:
            by[x].append(r)
    shared = Counter(p for v in by.values() for p in itertools.combinations(sorted(v), 2))
    links = [(a, b) for (a, b), c in shared.items() if c / (len(grams[a]) + len(grams[b]) - c) >= 0.8]
    comp = components(rep.values(), links)
    want = {i: comp[rep[" ".join(t.lower().split())]] for i, t in rows}
    got = {r.doc_id: r.component_id for r in simhash.near_duplicate_groups(docs).collect()}
    assert got.keys() == want.keys()
    assert got == want and len(set(want.values())) < len(rep)
    kept = simhash.one_of_each_group(docs.withColumn("sha", F.lit(1)))
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(x for x in ids if x is not None) == sorted(set(got.values())) and ids.count(None) == 1 and kept.columns == ["doc_id", "text", "sha"]
    assert simhash.one_of_each_group(docs.limit(0)).count() == 0


def test_op7(spark, documents, plain):
    own = [(i, t) for i, t, _ in plain if len(t) < 3000][:80]
    table = spark.createDataFrame(own, "doc_id bigint, text string").withColumn("string", F.lit(1))
    rows = {(r.doc_id, r.n_tokens): r for r in context_tree.score(table).collect()}
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in own}
    tokens = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) if w] + ["\n"]
    c = Counter(w for i, t in own if not held[i] for w in tokens(t))
    total = sum(c.values())
    # a plain context tree: each node's block probabilities by its decision counts
    counts: dict = defaultdict(lambda: [0, 0])
    coded = lambda t: b"".join((w.encode() + b" ") if w != "\n" else b"\n" for w in tokens(t))

    def bits(raw):
        raw = b"\n" * context_tree.DEPTH + raw
        for at in range(context_tree.DEPTH, len(raw)):
            for k in range(8):
                node = 1 << k | raw[at] >> (8 - k)
                yield raw[at - context_tree.DEPTH : at][::-1], node, raw[at] >> (7 - k) & 1

    for i, t in own:
        if not held[i]:
            for context, node, bit in bits(coded(t)):
                for d in range(context_tree.DEPTH + 1):
                    counts[context[:d], node][bit] += 1
    children = defaultdict(set)
    for context, node in counts:
        if context:
            children[context[:-1], node].add(context)
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)
    weighted: dict = {}
    for context, node in sorted(counts, key=lambda x: -len(x[0])):
        own_ = kt(*counts[context, node])
        below = sum(weighted[x, node] for x in children[context, node])
        weighted[context, node] = own_ if len(context) == context_tree.DEPTH else np.logaddexp(own_, below) - math.log(2)

    def p_one(context, node, d=0):
        a, b = counts.get((context[:d], node), (0, 0))
        est = (b + 0.5) / (a + b + 1)
        if d == context_tree.DEPTH or (context[:d], node) not in counts:
            return est
        w = math.exp(kt(a, b) - math.log(2) - weighted[context[:d], node])
        return w * est + (1 - w) * p_one(context, node, d + 1)

    for i, t in own[:12] + own[-4:]:
        ts = tokens(t)
        r = rows[i, len(ts)]
        assert (r.held_out, r.n_known, r.train_tokens) == (held[i], sum(c[w] > 0 for w in ts), total)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.5) / (total + 0.5 * (len(c) + 1))) for w in ts), rel_tol=1e-9)
        want = sum(math.log10(p if bit else 1 - p) for x, node, bit in bits(coded(t)) for p in [p_one(x, node)])
        assert math.isclose(r.score, want, rel_tol=1e-6), (i, r.score, want)
    assert context_tree.score(table.limit(0)).count() == 0


def test_op7_long_texts(monkeypatch):
    """A text longer than a run is cut; its strings, counts and sums are those of the whole."""
    monkeypatch.setattr(context_tree, "RUN_BYTES", 7)
    codes = [context_tree.coded(t)[1] for t in (b"abcabcabcabcabc abcabc " * 9, b"", b"a", b"abcabca abcabc")]
    tally, want = context_tree.Tally(), Counter()
    for code in codes:
        tally.add(code)
        padded = b"\n" * context_tree.DEPTH + code
        want.update(int.from_bytes(padded[i : i + context_tree.DEPTH][::-1] + padded[i + context_tree.DEPTH :][:1]) for i in range(len(code)))
    tally.count()
    assert dict(zip(tally.keys.tolist(), tally.counts.tolist(), strict=True)) == want and sorted(want) == tally.keys.tolist()
    slices = pa.table({"string": pa.array(list(want), pa.int64()), "word": pa.nulls(len(want), pa.binary()), "value": pa.array([x % 11 / 7 for x in want]), "known": pa.nulls(len(want), pa.int32())})
    totals = context_tree.Values(slices, (np.empty(0, np.int64), np.empty(0), {})).totals(codes)
    for code, total in zip(codes, totals, strict=True):
        assert math.isclose(total, sum(x % 11 / 7 for x in context_tree.strings_of([b"\n" * context_tree.DEPTH + code]).tolist()))


def test_op7_blocks(monkeypatch):
    """Blocks hold each document once; strings of training documents keep their counts, others count none."""
    monkeypatch.setattr(context_tree, "BLOCK_BYTES", 40)
    docs = [(i, ("x" * (i % 30) + " word") if i % 4 else None, i % 3 != 1) for i in range(25)]
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*docs, strict=True)], names=["doc_id", "text", "train"])
    made = pa.Table.from_batches(context_tree.packed_blocks(iter([batch])))
    packed = [x for x in made.column("packed").to_pylist() if x]
    rows = [(r["doc_id"], r["text"].decode(), r["train"]) for x in packed for r in pa.ipc.open_stream(x).read_all().to_pylist()]
    assert len(packed) > 3 and rows == [(i, t or "", train) for i, t, train in docs]
    strings = made.filter(made.column("string").is_valid())
    codes = [(context_tree.coded((t or "").encode())[1], train) for _, t, train in docs]
    assert sum(strings.column("n").to_pylist()) == sum(len(c) for c, train in codes if train)
    assert set(strings.column("string").to_pylist()) == {x for c, _ in codes for x in context_tree.strings_of([b"\n" * context_tree.DEPTH + c]).tolist()}
    assert len(strings) == len({(b, s) for b, s in zip(strings.column("block").to_pylist(), strings.column("string").to_pylist(), strict=True)})


def test_op8(spark):
    """Accuracy on the fold that no label was learnt from."""
    d = "/root/testdata/sf0.1"
    truth = spark.read.parquet(f"{d}/labels.parquet").where("toxic IS NOT NULL").select("doc_id", "toxic")
    rows = queries.op8_toxicity(spark, d).where("held_out").join(truth, "doc_id").collect()
    toxic, clean = [r.score for r in rows if r.toxic == 1], [r.score for r in rows if r.toxic == 0]
    assert len(toxic) > 10
    assert sum(s >= 0.5 for s in toxic) >= 0.9 * len(toxic) and sum(s < 0.5 for s in clean) >= 0.98 * len(clean)


def test_op8_edges(spark, documents):
    labels = spark.createDataFrame([(1, 1, None)], "doc_id bigint, quality int, toxic int")
    rows = toxicity.toxicity_report(documents, labels).collect()
    assert len(rows) == documents.count() and {r.predicted for r in rows} == {0}
    kept = toxicity.drop_toxic(documents, labels)
    assert kept.columns == documents.columns and kept.count() == documents.count()


def test_op9(spark):
    d = "/root/testdata/sf0.1"
    own = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding")
    nan, n = float("nan"), 64
    odd = [(100_000, None), (100_050, [0.0] * n), (100_100, [nan] * n), (100_150, [None] + [1.0] * (n - 1)), (100_200, [1.0] + [0.0] * (n - 1)), *((100_201 + k, [2.0] + [0.0] * (n - 1)) for k in range(9))]
    table = own.unionByName(spark.createDataFrame(odd, own.schema))
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in table.collect() if r.embedding and None not in r.embedding and np.isfinite(r.embedding).all() and any(r.embedding)]
    ids, x = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    found = defaultdict(list)
    for r in nn_descent.nearest(table, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
    asked = [int(i) for i in ids if i % 50 == 0]
    assert sorted(found) == sorted(asked)
    right = 0
    for q in asked:
        s = unit @ unit[ids == q][0]
        best = sorted((round(-v, 12), int(i)) for v, i in zip(s, ids) if i != q)[:5]
        assert len(found[q]) == 5 and all(math.isclose(v, s[ids == i][0], abs_tol=1e-12) for i, v in found[q])
        right += len({i for _, i in best} & {i for i, _ in found[q]})
    assert right >= 0.9 * 5 * len(asked)
    assert [i for i, _ in found[100_200]] == [100_201, 100_202, 100_203, 100_204, 100_205]
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id bigint, embedding array<float>")
    assert nn_descent.nearest(few, F.col("vec_id") % 50 == 0).count() == 1
    assert nn_descent.nearest(few.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_op10(spark, small):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{small}/pages.parquet").collect()]
    big = "é" * 600
    rows += [(50_000, "http://x/ä b", big), (50_001, None, big), (50_002, "u", big[:100]), (50_003, "u", big[:100]), (50_004, "u", None), (50_005, "u", "")]
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("payload", F.lit(1))
    last: dict = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 1000:
            last[h] = max(i, last.get(h, i))
    want = sorted((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if last.get(h, i) != i else "response", last[h] if last.get(h, i) != i else None) for i, _, h in rows for b in [(h or "").encode()])
    place = warc.write(table, file_bytes=20_000, shard_bytes=100_000)
    got = warc.read(spark, place).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got)) == want
    manifest = lambda p: sorted(map(tuple, spark.read.parquet(f"{p}/manifest").collect()))
    assert manifest(place) == manifest(warc.write(table.orderBy(F.desc("page_id")), file_bytes=20_000, shard_bytes=100_000)) and len(manifest(place)) > 3
    assert warc.read(spark, warc.write(table.limit(0))).count() == 0
