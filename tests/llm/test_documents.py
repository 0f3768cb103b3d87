"""Text operators against brute force on small tables with nulls, empty texts, ties and repeated rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from rasterloom.llm import bpe, langid, license, lines, mixing, quality, shingles, simhash, tokens
from rasterloom.llm.common import connected, fold, prepare, sampled

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = "the of and to tion ing that with for was on are as his they be at one have this from or had by".split()


def prose(rng, n, words=WORDS):
    return " ".join(rng.choice(words) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = []
    for i in range(60):
        body = [prose(rng, rng.randint(3, 12)) for _ in range(rng.randint(1, 9))]
        out.append((i, "\n".join(body), rng.choice(["en", "de"]), f"s{i % 4}"))
    shared = "\n".join(prose(rng, 8) for _ in range(12))
    out += [(100 + i, prose(rng, 5) + "\n" + shared + "\n" + prose(rng, 5), "en", "s0") for i in range(5)]
    out += [(i + 200, out[i][1], "en", "s1") for i in range(4)]  # exact copies
    out += [(300, None, "en", "s1"), (301, "", None, None), (302, " \n\t ", "en", None), (None, "one two three", "en", "s2"), (303, "x" * 5000, "en", "s3"),
            (304, prose(rng, 4000), "en", "s3"), (305, "### 123 !!!", "en", ""), (306, None, None, None), (307, "a  b\n\n c \x1c d", "en", "s0")]
    out += [out[0], out[0], (300, None, "en", "s1")]  # repeated rows
    return [(i, t, g, s, None if t is None else len(t)) for i, t, g, s in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    prepare(spark)
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def clash(df):
    """The table with columns that bear names of results and intermediates."""
    return df.withColumns({c: F.lit(7) for c in ("score", "size", "target", "taken", "source_size", "n_lines", "version", "gone", "mark", "predicted", "fp", "ids", "component_id", "_source")})


def key(row):
    return str([str(x) for x in row])


def test_mix_takes_each_budget_exactly(spark, docs, rows):
    got = [r.asDict() for r in mixing.mix(docs).collect()]
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    per = defaultdict(int)
    for _, t, _, s, _ in rows:
        per[s] += size(t)
    order = sorted((s for s in per if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, total, free = {}, sum(per.values()), set(order)
    while free:  # reshare what capped sources leave
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * per[s]}
        target.update({s: 3 * per[s] for s in over} if over else share)
        free -= over or free
    taken = defaultdict(int)
    for r in got:
        assert r["size"] == size(r["text"]) and r["source_size"] == per[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in order:
        assert taken[s] == int(target[s] + 0.5)
    again = sorted(key(r) for r in mixing.mix(docs.repartition(7)).select("doc_id", "size", "taken").collect())
    assert again == sorted(key((r["doc_id"], r["size"], r["taken"])) for r in got)


def test_mix_with_many_ranges_equals_one(spark, docs, monkeypatch):
    one = sorted(key(r) for r in mixing.mix(docs).select("doc_id", "size", "taken").collect())
    monkeypatch.setattr(mixing, "RANGE_ROWS", 2)
    assert sorted(key(r) for r in mixing.mix(docs).select("doc_id", "size", "taken").collect()) == one


def test_mix_edges(spark, docs):
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mixed_documents(docs.limit(0)).columns == docs.columns
    odd = mixing.mixed_documents(clash(docs))
    assert odd.columns == clash(docs).columns and odd.count() > 0
    assert "Python" not in mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()


def brute_lines(rows):
    """Every chunk of every document held in the driver; repeated rows count as occurrences of one document."""
    place = lambda i, t, a: (i is not None, i or 0, xxhash.xxh64_intdigest(t.encode(), 42), a)
    held = defaultdict(list)
    for i, t, *_ in rows:
        if t is not None:
            ls = t.encode().split(b"\n")
            for a, b in lines.chunks_of(ls):
                held[b"\n".join(ls[a:b])].append((i, t, a, b))
    first, later = defaultdict(int), defaultdict(int)
    for found in held.values():
        earliest = min(place(i, t, a) for i, t, a, _ in found)
        for i, t, a, b in found:
            side = first if place(i, t, a) == earliest else later
            for k in range(a, b):
                side[i, t, k] = max(side[i, t, k], len(found) if len(found) > 1 else 0)
    return {(i, t): "\n".join(x for k, x in enumerate(t.split("\n")) if later[i, t, k] <= first[i, t, k]) for i, t, *_ in rows if t is not None}


def test_line_chunks(spark, docs, rows, monkeypatch):
    want = brute_lines(rows)
    for _ in range(2):
        got = lines.dedup_lines(docs).collect()
        assert len(got) == len(rows)
        left = sorted((r["doc_id"] or -1, r["text"] or "") for r in got)
        assert left == sorted((i or -1, want[i, t] if t is not None else "") for i, t, *_ in rows)
        assert sum(r["lines_removed"] for r in got) > 30
        for r in got:
            if r["text"] is None:
                assert r["n_lines"] == 0 and r["lines_removed"] == 0
        monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda data, seed=0: 5)  # every hash collides: bytes decide
    assert lines.deduped_documents(clash(docs)).columns == clash(docs).columns
    assert lines.dedup_lines(docs.limit(0)).count() == 0


def test_chunk_borders_resist_shifts():
    rng = random.Random(2)
    body = [prose(rng, 6).encode() for _ in range(60)]
    chunks = lambda ls: {b"\n".join(ls[a:b]) for a, b in lines.chunks_of(ls)}
    cut = chunks(body[:30]) | chunks(body[30:])
    moved = chunks([b"new line", *body[:30], b"another", *body[30:]])
    assert cut <= moved  # what stands around a passage moves none of its chunks
    assert sum(b - a == 2 for a, b in lines.chunks_of(body)) > 50
    assert lines.chunks_of([]) == lines.chunks_of([b"a"]) == lines.chunks_of([b""] * 9) == []
    assert lines.chunks_of([b"w " * 51]) == [(0, 1)] and lines.chunks_of([b"word" * 300]) == []


def test_first_occurrences_stay_whole(spark):
    """A chain of overlapping pairs: each pair's first occurrence is intact unless a more frequent passage takes a line."""
    rng = random.Random(3)
    for _ in range(200):  # three lines whose pairs are chunks
        x, y, z = (prose(rng, 9) for _ in range(3))
        if {(0, 2), (1, 3)} <= set(lines.chunks_of([v.encode() for v in (x, y, z)])):
            break
    df = spark.createDataFrame([(0, f"{y}\n{z}"), (1, f"{x}\n{y}\n{z}"), (2, f"{x}\n{y}")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["text"] for r in lines.deduped_documents(df).collect()}
    assert got == {0: f"{y}\n{z}", 1: f"{x}\n{y}", 2: ""}


def test_every_repeated_passage_goes(spark):
    """Two shared lines, or one long one, leave wherever they stand; borders don't matter, and no line is lost."""
    rng = random.Random(12)
    body, data = [], []
    for k in range(40):  # passages of two lines, three lines and one long line, between lines of their own
        shared = [f"{prose(rng, 30)} {k} {j}" for j in range(2 + k % 2)] if k % 3 else [f"{prose(rng, 60)} {k}"]
        body.append(shared)
        for copy in range(2):
            data.append((2 * k + copy, "\n".join([f"{prose(rng, 6)} own {k} {copy} {j}" for j in range(2)] + shared + [f"{prose(rng, 6)} last {k} {copy}"])))
    data += [(900, "a b\n\n\nc d"), (901, "e f\n\n\ng h"), (902, "same\nsame\nsame"), (903, None), (904, ""), (905, "short"), (906, "short")]
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    got = {r["doc_id"]: r["text"] for r in lines.deduped_documents(df).collect()}
    caught = 0
    for k, shared in enumerate(body):
        left = got[2 * k + 1].split("\n")
        assert set(shared) <= set(got[2 * k].split("\n")) and len(set(left) - set(shared)) == 3
        caught += not set(shared) & set(left)
    assert caught >= 38
    assert {i: got[i] for i in range(900, 907) if i != 902} == {i: t for i, t in data[-7:] if i != 902}
    assert {x for t in got.values() if t for x in t.split("\n")} == {x for _, t in data if t for x in t.split("\n")}


def test_bpe_equals_the_library(spark, docs, rows):
    import tiktoken

    codec = bpe.ByteBpe.load(BPE, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    got = {(r["doc_id"], r["ids_sha256"]): r for r in bpe.round_trip(clash(docs), BPE, public_tokenizers.PATTERN).collect()}
    for i, t, *_ in rows:
        ids = library.encode_ordinary(t or "")
        r = got[i, hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()]
        assert r["n_tokens"] == len(ids) and r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.round_trip(docs.limit(0), BPE, public_tokenizers.PATTERN).count() == 0
    rng = random.Random(1)
    parts = ["a", "aa", "b", " ", "  ", "\n", "\x1c", "\x85", "é", "漢", "'s", "'", "1", "😀", "-", "!!", "the", "tion", "\t", "A"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == library.encode_ordinary(text), repr(text)


def test_bpe_is_a_monoid():
    codec = bpe.ByteBpe.load(BPE, public_tokenizers.PATTERN)
    assert all(codec.merge(data) == (i,) for data, i in list(codec.ranks.items())[::7])
    rng = random.Random(8)
    for _ in range(300):
        data = bytes(rng.choice(b"thaeion   \xc3\xa9") for _ in range(rng.randint(0, 60)))
        cut = rng.randint(0, len(data))
        whole = codec.merge(data) if data else ()
        assert codec.join(codec.encode_bytes(data[:cut]), codec.encode_bytes(data[cut:])) == whole == codec.encode_bytes(data)
        assert codec.decode(list(whole)) == data
    long = b"ab" * 3000
    assert codec.encode_bytes(long) == codec._merge_long(long)


def test_token_files(spark, docs, rows, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    tokens.write_tokens(clash(docs), str(tmp_path / "t"), path, 2)
    got = [tuple(r) for r in tokens.read_checksums(spark, str(tmp_path / "t")).collect()]
    stored = {(r["doc_id"], r["start"]): r["ids"] for r in tokens.read_tokens(spark, str(tmp_path / "t")).collect()}
    assert all(zlib.crc32(np.array(stored[i, at], "<u4").tobytes()) == crc for i, at, _, crc in got)
    coded = lambda t: np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
    assert sorted((r[0] or -1, r[2], r[3]) for r in got) == sorted((i or -1, len(coded(t)), zlib.crc32(coded(t).tobytes())) for i, t, *_ in rows)
    at = 0
    for doc_id, start, n, _ in sorted(got, key=lambda r: r[1]):
        assert start == at
        at += n
    order = [r[0] if r[0] is not None else -1 for r in sorted(got, key=lambda r: r[1])]
    assert order == sorted(order)
    tokens.write_tokens(docs.limit(0), str(tmp_path / "none"), path, 2)
    assert tokens.read_checksums(spark, str(tmp_path / "none")).count() == 0 and tokens.read_tokens(spark, str(tmp_path / "none")).count() == 0


def test_encoding_equals_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, coder = Tokenizer.from_file(path), tokens.Tokens(path)
    rng = np.random.default_rng(3)
    bits = ["word", "Über", "don't", "it's,", "a.", "b!!!", "x_y", "42", "3rd.", "\n", "\n\n", " ", "  ", "\t", "...", "'s", "né", "日本", "\u00a0", "<|endoftext|>", "<|endof", "\0", "\1", "!\n", "e\u0301.", "ªº.", "'"]
    texts = ["see <|endoftext|> here", "a\nb. c,\nd", "\n", None, "", " ", "a b\n", "x" * 300, "word. word.\nWord, 'quoted' (words)\nend"]
    texts += ["".join(rng.choice(bits, rng.integers(1, 12))) for _ in range(600)] + [" ".join(rng.choice(bits, rng.integers(1, 12))) for _ in range(600)]
    texts += ["\n".join(rng.choice(bits[:9], rng.integers(1, 12))) for _ in range(100)] + ["long text. " * 300_000]
    for _ in range(2):
        ids, n = coder.encode(texts, 2)
        ends = np.cumsum(n)
        for t, lo, hi in zip(texts, ends - n, ends):
            assert ids[lo:hi].tolist() == [*library.encode(t or "", add_special_tokens=False).ids, 2], t
        coder.older, coder.words = coder.words, {}
    assert ids[:n[0]].tolist() == [*library.encode(texts[0], add_special_tokens=False).ids, 2] and 50256 in ids[:n[0]].tolist()
    assert coder.encode([], 2)[0].tolist() == []


def test_simple8b_round_trips():
    rng = np.random.default_rng(0)
    for k in range(200):
        top = int(rng.choice([1, 2, 4, 100, 50257, 2**31, 2**59, 2**63]))
        ids = rng.integers(0, top, int(rng.integers(0, 500)), dtype=np.uint64)
        if k % 3 == 0 and len(ids):
            ids = np.repeat(ids, rng.integers(1, 90, len(ids)))
        words, offsets = tokens.pack_blocks(ids)
        assert np.array_equal(tokens.unpack_blocks(words, offsets), ids)
    assert len(tokens.pack(np.full(8000, 9, np.uint64))) == 1


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash_components(spark, docs, rows):
    fps = {i: brute_fingerprint(t) for i, (_, t, *_) in enumerate(rows)}
    near = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 3]
    root = brute_components(near, fps)
    least = defaultdict(list)
    for n, (i, *_) in enumerate(rows):
        if i is not None:
            least[root[n]].append(i)
    want = sorted(key((i, f"{fps[n]:016x}", min(least[root[n]], default=None))) for n, (i, *_) in enumerate(rows))
    assert sorted(key(r) for r in simhash.near_copies(clash(docs)).collect()) == want
    kept = simhash.one_of_each(docs)
    assert kept.count() == len(set(root.values())) and kept.columns == docs.columns
    assert simhash.near_copies(docs.limit(0)).count() == 0 and simhash.one_of_each(docs.limit(0)).count() == 0


def test_near_copies_by_shingles(spark):
    """Components of five-word Jaccard 0.8 or more against all pairs: edits that fingerprints miss, a large group, odd rows."""
    rng = random.Random(9)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    data = []

    def edited(words, times):
        out = list(words)
        for at in rng.sample(range(len(out)), times):
            out[at] = fresh(1)[0]
        return out

    for k in range(40):  # 200 words with 0 to 8 words changed: similarity from 1 to about 0.67
        words = fresh(200)
        data += [(2 * k, " ".join(words)), (2 * k + 1, "\n".join(edited(words, k % 9)).upper())]
    hot = fresh(120)
    data += [(200 + k, " ".join(edited(hot, 1))) for k in range(120)]
    data += [(400, None), (401, ""), (402, " \n"), (403, "one two"), (404, "ONE  two"), (405, "one three"), (None, "one two"), (406, data[0][1]), (406, data[0][1])]
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    sets = [{" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for _, t in data]
    alike = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    root = brute_components([(i, j) for j in range(len(data)) for i in range(j) if alike(sets[i], sets[j])], range(len(data)))
    groups = defaultdict(set)
    for n, (i, _) in enumerate(data):
        groups[root[n]].add(i)
    mine = defaultdict(set)
    for r in shingles.components(df).collect():
        mine[r["root"]].add(r["doc_id"])
    assert sorted(map(str, map(sorted, [[-1 if i is None else i for i in g] for g in mine.values()]))) == sorted(
        map(str, map(sorted, [[-1 if i is None else i for i in g] for g in groups.values()])))
    kept = corpus_pipeline.drop_near_copies(spark, df, "")
    assert kept.columns == df.columns and kept.count() == len(groups)
    far = [(a, b) for a, b in zip(range(0, 80, 2), range(1, 80, 2)) if alike(sets[a], sets[b]) and (simhash.fingerprint(data[a][1]) ^ simhash.fingerprint(data[b][1])).bit_count() > 3]
    assert len(far) > 5  # pairs that the fingerprints' radius does not reach
    assert shingles.components(df.limit(0)).count() == 0


def test_pipeline_links_by_fingerprints_too(spark):
    """Links of op6 count in the pipeline, alone and in a chain with links by shingle sets."""
    rng = random.Random(12)
    words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    repeated = words[:59] * 40  # five-word sets see a repeated passage once, fingerprints count it
    longer = repeated + words[100:160]
    edited = [*longer[:-1], "other"]
    data = [(0, " ".join(repeated)), (1, " ".join(longer)), (2, " ".join(edited)), (3, " ".join(words[300:])), (4, None)]
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    by_sets = {r["doc_id"]: r["root"] for r in shingles.components(df).collect()}
    assert by_sets[0] != by_sets[1]
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()) == [0, 3, 4]


def test_token_parts_are_put_together_in_steps(monkeypatch):
    """Few words at a time give the same ids, with texts that go to the library whole and texts beyond a step."""
    coder = tokens.Tokens(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a b, c.", None, "see <|endoftext|> here", "word " * 50, "", "x\0y", "one\ntwo three"] * 3
    want = coder.encode(texts, 2)
    for step in (1, 4, 30):
        monkeypatch.setattr(tokens, "STEP", step)
        got = coder.encode(texts, 2)
        assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist()


def test_bpe_round_trip_takes_one_worker(spark, docs):
    """One vocabulary an executor core: encoding and decoding are one step."""
    plan = bpe.round_trip(docs, BPE, public_tokenizers.PATTERN)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_all_texts_of_a_key_meet(spark, monkeypatch):
    """Groups in which each text is like two neighbours only: centres miss links, blocks find what shares a key; blocks of any size agree."""
    rng = random.Random(12)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    shared = fresh(165)  # a template: texts of one group share most keys
    data = []
    for g in range(30):
        own = fresh(35)
        for m in range(2):
            words = list(own)
            words[rng.randrange(35)] = fresh(1)[0]
            data.append((len(data), " ".join(shared[:120 + g] + words)))
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    sets = [shingles.shingle_set(t) for _, t in data]
    keys = [set(shingles.keys_of(s).tolist()) for s in sets]
    alike = [(i, j) for j in range(len(data)) for i in range(j) if keys[i] & keys[j] and shingles._alike(np.sort(sets[i]), np.sort(sets[j]))]
    want = defaultdict(set)
    for n, r in brute_components(alike, range(len(data))).items():
        want[r].add(n)

    def groups():
        out = defaultdict(set)
        for r in shingles.components(df).collect():
            out[r["root"]].add(r["doc_id"])
        return sorted(map(sorted, out.values()))

    assert groups() == sorted(map(sorted, want.values()))
    monkeypatch.setattr(shingles, "BLOCK", 3)
    assert groups() == sorted(map(sorted, want.values()))
    centred = shingles._centred
    monkeypatch.setattr(shingles, "_centred", lambda keyed: centred(keyed).limit(0))  # the blocks alone find all links
    assert groups() == sorted(map(sorted, want.values()))


def test_golay_keys_find_every_pair_within_three_bits(spark):
    table = simhash.error_table()
    assert (table >= 0).all() and {int(e).bit_count() for e in table} == {0, 1, 2, 3}
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    flips = np.zeros(400, np.uint64)
    for i in range(400):
        for b in rng.choice(64, int(rng.integers(1, 4)), replace=False):
            flips[i] |= np.uint64(1) << np.uint64(b)
    pairs = spark.createDataFrame([(int(x),) for x in np.concatenate([base, base ^ flips]).view(np.int64)], "fp bigint").distinct()
    got = {(r["u"], r["v"]) for r in simhash.links(pairs).collect()}
    both = lambda a, b: (max(a, b), min(a, b))
    assert got >= {both(int(a), int(b)) for a, b in zip(base.view(np.int64), (base ^ flips).view(np.int64))}


def test_connected_on_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(500, 501), (501, 502), (502, 500), (7, 7), (600, 601), (601, 600)]
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    want = brute_components([e for e in edges if e[0] != e[1]], {n for e in edges for n in e})
    assert got == {n: r for n, r in want.items() if n != r}


def test_license_places_and_templates(spark, docs):
    texts = [
        (1, "Licensed under CC BY-NC 4.0. Text. CC BY again; all rights, reserved"), (2, None), (3, ""), (4, "Released under the terms of the MIT License."),
        (5, "Released under a MIT License."), (6, "licensed under the GNU General Public License, version 3."), (7, "Copyright (c) 2020 A. N. Other. All rights reserved."),
        (8, "copyright one two three four five six seven all rights reserved"), (None, "Licensed under the Apache License, Version 2.0."), (9, "cc  by cc by"),
    ]
    df = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id bigint, text string, labels int")
    got = {r["doc_id"]: r for r in license.summary(license.scan(df)).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"]) == (3, 2, 11)
    assert (got[1]["base_labels"], got[1]["labels"]) == ("cc-by,reserved", "cc-by,cc-by-nc-4.0,reserved")
    assert (got[2]["n_words"], got[2]["labels"], got[2]["first_word"], got[2]["score"]) == (0, "", None, 0.0)
    assert got[4]["labels"] == "mit" and got[5]["labels"] == "" and got[6]["labels"] == "gpl,gpl-3.0"
    assert got[7]["labels"] == "copyright,reserved" and got[8]["labels"] == "reserved" and got[None]["labels"] == "apache-2.0"
    assert got[9]["n_base"] == 2 and got[9]["score"] == 1.0
    assert license.scan(docs.limit(0)).count() == 0 and license.summary(license.scan(clash(docs))).count() == docs.count()


def accepts(markup, words):
    """Template match at the start of ``words`` by a regular expression over words."""
    body = re.sub(r"\{\{(\d+)\}\}", r"(?:\\S+ ){1,\1}", " ".join(markup.split()))
    parts = re.split(r"(\[\[|\]\]|\(\?:\\S\+ \)\{1,\d+\})", body)
    exp = "".join({"[[": "(?:", "]]": ")?"}.get(p, p if p.startswith("(?:") else "".join(w + " " for w in p.split())) for p in parts)
    m = re.match(exp, " ".join(words) + " ")
    return bool(m)


def test_automata_agree_with_regular_expressions():
    rng = random.Random(3)
    for group in license.TEMPLATES.values():
        for markup in group:
            automaton = license.compile_template("x", markup)
            plain = [w for w in re.sub(r"\[\[|\]\]|\{\{\d+\}\}", " ", markup).split()]
            for _ in range(60):
                words = list(plain)
                for _ in range(rng.randint(0, 3)):
                    at = rng.randrange(len(words))
                    words[at:at + rng.randint(0, 1)] = rng.choice([[], ["zz"], [words[at]]])
                    words = words or ["zz"]
                assert bool(automaton.longest([w.encode() for w in words], 0)) == accepts(markup, words), (markup, words)


def test_language_model(spark):
    rng = random.Random(6)
    vocabulary = {"en": "the thing which another thought weather", "de": "der schicht auch nicht über straße", "fr": "le château être garçon où élève", "es": "el niño año señor qué está"}
    data = [(i, prose(rng, 40, v.split()), g, "s", 1) for g, v in vocabulary.items() for i in range(hash_start(g), hash_start(g) + 60)]
    data += [(9000, None, "en", "s", 1), (9001, "", "en", "s", 1), (9002, "12 ### 34", None, "s", 1), (9003, prose(rng, 30, vocabulary["fr"].split()), None, None, None), (None, "le garçon", "fr", "s", 1)]
    data += [data[0]]
    df = spark.createDataFrame(data, SCHEMA)
    model = langid.fit(df)
    assert model.families == {"germanic": ["de", "en"], "romance": ["es", "fr"]}
    got = langid.identify(clash(df), model).collect()
    assert len(got) == len(data)
    truth = {d[0]: d[2] for d in data}
    for r in got:
        assert 0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode() if r["doc_id"] is not None else b"") % 3 == 1)
        if r["doc_id"] in (9000, 9001, 9002):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        elif r["doc_id"] == 9003:
            assert r["lang_pred"] == "fr"
        else:
            assert r["lang_pred"] == truth[r["doc_id"]]
    nothing = langid.fit(df.limit(0))
    assert {r["lang_pred"] for r in langid.identify(df, nothing).collect()} == {"und"}
    assert np.allclose(langid.features("ab c" * 10), langid.features("AB  C" * 10))


def hash_start(language):
    return {"en": 0, "de": 1000, "fr": 2000, "es": 3000}[language]


def test_samples_under_repeated_ids(spark):
    """Few ids with many texts, one row repeated often, many classes: the sample is neither empty nor unbounded."""
    few = spark.range(20000).select((F.col("id") % 3).alias("doc_id"), F.lit("en").alias("lang"), F.col("id").alias("version"))
    assert 300 < sampled(few, "lang", 400).count() < 500
    once = spark.range(20000).select(F.lit(7).alias("doc_id"), F.lit("en").alias("lang"), F.lit(1).alias("version"))
    assert sampled(once, "lang", 400).count() == 1
    many = spark.range(20000).select(F.col("id").alias("doc_id"), (F.col("id") % 200).alias("lang"), F.lit(1).alias("version"))
    assert 1600 < sampled(many, "lang", 400, 2000).count() < 2400
    assert sampled(few.limit(0), "lang", 400).count() == 0


def test_svm_against_a_direct_solution(monkeypatch):
    """Dual coordinate descent against gradient descent on the primal; rows that overlap in five dimensions take more epochs than texts."""
    monkeypatch.setattr(langid, "EPOCHS", 3000)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 5))
    y = np.where(x @ rng.normal(size=5) + 0.3 * rng.normal(size=60) > 0, 1.0, -1.0)
    w, ones = np.zeros(6), np.hstack([x, np.ones((60, 1))])
    for _ in range(60000):
        gap = np.maximum(0, 1 - y * (ones @ w))
        w -= 1e-4 * (w - 2 * langid.MARGIN_COST * ((gap * y) @ ones))
    loss = lambda v: 0.5 * v @ v + langid.MARGIN_COST * (np.maximum(0, 1 - y * (ones @ v)) ** 2).sum()
    assert loss(langid.svm(x, y, 0)) <= loss(w) * 1.01


def test_votes_by_hand():
    text, unit = "abc abd", langid.WIDTH + 1
    bias = lambda b: np.concatenate([np.zeros(unit - 1), [b]])
    model = langid.LanguageModel({"f": ["a", "b", "c"], "g": ["d"]}, {"f": bias(0.5), "g": bias(-0.5)}, {("a", "b"): bias(0.1), ("a", "c"): bias(-0.2), ("b", "c"): bias(0.3)})
    p = lambda b: 1 / (1 + np.exp(-4 * b))
    votes = {"a": p(0.1) + p(-0.2), "b": 1 - p(0.1) + p(0.3), "c": 2 - p(-0.2) - p(0.3)}
    best = max(votes, key=votes.get)
    lang, score = model.predict(text)
    assert lang == best and abs(score - p(0.5) * votes[best] / 2) < 1e-12


def test_factor_machine(spark):
    rng = random.Random(6)
    good = [(i, "\n".join(prose(rng, 10) for _ in range(4)), "en", "s", 200) for i in range(150)]
    bad = [(1000 + i, " ".join(w.upper() + "!!" for w in prose(rng, 30).split()), "en", "s", None) for i in range(60)]
    odd = [(5000, None, "en", "s", None), (5001, "", "en", "s", 0), (None, "x", None, None, 1)]
    df = spark.createDataFrame(good + bad + odd, SCHEMA)
    labels = spark.createDataFrame([(d[0], 1, 0) for d in good] + [(d[0], 0, 0) for d in bad] + [(5000, None, 0), (None, 1, 0), (3, 1, 0), (77777, 0, 0)], "doc_id bigint, quality int, toxic int")
    model = quality.fit(df, labels)
    got = {r["doc_id"]: r for r in quality.score(clash(df), model).collect()}
    for d in good + bad:
        if zlib.crc32(str(d[0]).encode()) % 4 == 2:
            assert got[d[0]]["predicted"] == int(d[0] < 1000)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values()) and len(got) == len(df.collect())
    kept = quality.accepted(df, model)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["predicted"] == 1}
    blank = quality.fit(df, labels.limit(0))
    assert {round(r["score"], 6) for r in quality.score(df, blank).collect()} == {0.5}
    assert quality.score(df.limit(0), model).count() == 0


def test_sum_of_squares_identity():
    model = quality.FactorMachine(0.2, np.random.default_rng(0).normal(size=quality.WIDTH), np.random.default_rng(1).normal(size=(quality.WIDTH, quality.RANK)))
    index, x = quality.features("The cat sat!! on the mat\nthe cat", 30)
    pairs = sum(model.v[index[i]] @ model.v[index[j]] * x[i] * x[j] for i in range(len(index)) for j in range(i))
    assert model.margin(index, x) == pytest.approx(0.2 + model.w[index] @ x + pairs)


def test_folds(spark):
    df = spark.range(50).select(fold(F.col("id"), 3).alias("f"), "id")
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 3 for r in df.collect())
