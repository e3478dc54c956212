"""Fill-in-middle, token alignment and SimHash groups against brute-force versions; edge cases of each."""

import hashlib
import json
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteflux.llm import alignment, infill, simhash
from siteflux.llm.common import components

DOCS = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    vocab = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(300)]
    base = [" ".join(rng.choice(vocab, rng.integers(5, 120))) for _ in range(40)]
    texts = dict(enumerate(base))
    for i in range(40, 90):  # near copies
        words = base[i % 6].split()
        for _ in range(1 + i % 2):
            words[rng.integers(len(words))] = "x%d" % rng.integers(50)
        texts[i] = " ".join(words)
    texts |= {90 + i: base[3] for i in range(9)}
    texts |= {100: None, 101: "", 102: " \t\n", 103: "one", 104: "one two", 105: "ONE  two", 106: "a\n\n  b \x0b c  ", 107: "x <P> y z"}
    texts |= {108: "Été 日本語のテキスト \U0001d518 café\x1cx y  a b▁c", 109: "no▁space", 110: "<|endoftext|> <s> <0x41> <unk> </s>", 111: " ".join(base) * 3}
    texts |= {112: "<", 113: "z" * 3000, 114: "a   b\n \n c\t\td ", 115: "  b\u0085 c   d", 116: "half <", 117: "> half"}
    out = [(i, t, "en", "ab"[i % 2], None) for i, t in texts.items()]
    return [*out, (None, base[3], "en", None, None), (0, base[0], "en", "a", None), (None, None, None, None, None)]


def test_skip_list_reaches_every_rank():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 8, 9, 63, 64, 65, 513, 5000):
        widths = rng.integers(1, 50, n)
        listed, sums = infill.SkipList(widths), np.append(0, np.cumsum(widths))
        assert len(listed.lanes) <= 1 + np.log(max(n, 1)) / np.log(infill.SPAN)
        for rank in {0, n, *rng.integers(0, n + 1, 50).tolist()}:
            assert listed.reach(rank) == sums[rank]
        with pytest.raises(IndexError):
            listed.reach(n + 1)


def infill_brute(doc, text):
    text = text or ""
    units = UNIT.findall(text)
    assert "".join(units) == text
    digest = hashlib.sha256(f"42:{'null' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_against_brute_force(spark, rows):
    docs = spark.createDataFrame(rows, DOCS).withColumn("form", F.lit("mine")).withColumn("_cut", F.lit(1))
    out = infill.fill_in_middle(docs)
    got = out.select("*", infill.restore(F.col("output"), F.col("form")).alias("back")).collect()
    want = Counter((i, *infill_brute(i, t)) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert all(r.back == (r.given.text or "") and r.given.form == "mine" for r in got)


def test_fill_in_middle_settings_and_empty_table(spark, rows):
    docs = spark.createDataFrame(rows, DOCS)
    assert infill.fill_in_middle(docs.limit(0)).count() == 0
    out = infill.fill_in_middle(docs, seed=7, rate=100, suffix_first=0, marks=("<a>", "<b>", "<c>"))
    back = infill.restore(F.col("output"), F.col("form"), ("<a>", "<b>", "<c>"))
    assert {r.form for r in out.where("given.text <> ''").collect()} == {"psm"}
    assert out.where(back != F.coalesce("given.text", F.lit(""))).isEmpty()
    with pytest.raises(ValueError):
        infill.fill_in_middle(docs, marks=("<a>", "<a>", "<c>"))


@pytest.fixture(scope="module")
def vocabularies():
    import public_tokenizers
    import sentencepiece
    import tokenizers

    a = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return a, b


def test_ids_are_those_of_the_vocabulary_files(vocabularies, rows):
    import pyarrow.parquet as pq

    texts = [t or "" for _, t, *_ in rows]
    texts += [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()]
    texts += ["", " ", "  ", "a b", "a  b", "a \n b", "\u180e \u180e x", "don't  we'll 12 3", "x ", " x", "a\t b", "a \tb", "\u2581 a", "a \u2581", "\u00a0 \u3000 b", "\u0378\U0001f9ff\U00031350 \u0c5d", "q" * 9000]
    one, two = alignment.byte_level(), alignment.pieces()
    want_a = [vocabularies[0].encode(" " + t, add_special_tokens=False).ids for t in texts]
    want_b = vocabularies[1].encode(texts)
    for tokens, want in ((one, want_a), (two, want_b)):
        joined = [b"".join(tokens.table[i] for i in ids) == (" " + t).encode() for ids, t in zip(want, texts)]
        want = [ids if t and same else None for ids, t, same in zip(want, texts, joined)]
        assert [None if x is None else x.tolist() for x in tokens.encode(texts)] == want


def align_brute(text, vocabularies):
    """Groups and linked pairs of one text, by comparing all ranges."""
    a, b = vocabularies
    if not text:
        return [], []
    decoder = {v: k for k, v in json_bytes().items()}
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(decoder[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
        return [], []
    ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]), np.cumsum([len(x) for x in bytes_b])
    common = {*ends_a.tolist()} & {*ends_b.tolist()}
    sides = []
    for ids, ends in ((ids_a, ends_a), (ids_b, ends_b)):
        parts = [[]]
        for i, e in zip(ids, ends.tolist()):
            parts[-1].append(i)
            if e in common:
                parts.append([])
        sides.append(parts[:-1])
    groups = list(zip(*sides))
    links, first = [], 0
    for i, (y, e) in enumerate(zip(ids_b, ends_b)):
        s = e - len(bytes_b[i])
        while ends_a[first] <= s:
            first += 1
        at = first
        while at < len(ids_a) and ends_a[at] - len(bytes_a[at]) < e:
            links.append((ids_a[at], y))
            at += 1
    return groups, links


def json_bytes():
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    table, extra = {}, 0
    for b in range(256):
        if b in shown:
            table[b] = chr(b)
        else:
            table[b] = chr(256 + extra)
            extra += 1
    return table


@pytest.mark.parametrize("frequent", [alignment.FREQUENT, 40])
def test_alignment_against_brute_force(spark, rows, vocabularies, frequent):
    docs = spark.createDataFrame(rows, DOCS).withColumn("pairs", F.lit(1)).withColumn("row", F.lit(0))
    known = [(i, *align_brute(t, vocabularies)) for i, t, *_ in rows]
    counts = Counter(pair for _, _, links in known for pair in links)
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    want = Counter()
    for i, groups, links in known:
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        n_best = sum(counts[x] == most[x[1]] for x in links)
        row = (i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), n_best, sum(counts[x] for x in links))
        want[(*row, hashlib.sha256(text.encode()).hexdigest() if text else "")] += 1
    got = alignment.aligned_counts(docs, frequent=frequent).collect()
    assert Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got) == want
    assert sum(not groups for _, groups, _ in known) >= 4  # null, empty and texts with the piece model's space


def test_alignment_writes_all_groups_and_takes_empty_tables(spark, rows, vocabularies):
    docs = spark.createDataFrame(rows, DOCS)
    got = Counter((r.doc_id, r.groups) for r in alignment.align(docs).collect())
    texts = [(i, align_brute(t, vocabularies)[0]) for i, t, *_ in rows]
    assert got == Counter((i, ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)) for i, g in texts)
    assert alignment.aligned_counts(docs.limit(0)).count() == 0


def test_long_chains_of_overlaps_are_one_group():
    n = 1000  # tokens of two bytes against tokens that are shifted by one
    ends_a = np.append(np.arange(2, 2 * n + 1, 2), 2 * n + 1)
    ends_b = np.append(np.arange(1, 2 * n, 2), [2 * n + 1])
    a, b = alignment.group_tokens(ends_a, ends_b)
    assert set(a) == set(b) == {0}
    a, b = alignment.group_tokens(ends_a, ends_a)
    assert a.tolist() == b.tolist() == list(range(n + 1))


def simhash_brute(text):
    import xxhash

    words = WORD.findall(lowered(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> i & 1 for h in hashes) > len(hashes)) << i for i in range(64))


def groups_brute(prints):
    """For each different fingerprint the least (as unsigned number) that it reaches."""
    prints = sorted(set(prints))
    least = {p: p for p in prints}
    todo = set(prints)
    while todo:
        start = min(todo)
        todo.remove(start)
        seen, stack = [start], [start]
        while stack:
            p = stack.pop()
            near = [q for q in todo if (p ^ q).bit_count() <= 2]
            todo.difference_update(near)
            seen += near
            stack += near
        least.update(dict.fromkeys(seen, start))
    return least


def test_simhash_groups_against_brute_force(spark, rows):
    docs = spark.createDataFrame(rows, DOCS).withColumn("fingerprint", F.lit("x")).withColumn("first", F.lit("y"))
    prints = [simhash_brute(t) for _, t, *_ in rows]
    least = groups_brute(prints)
    members = {}
    for (i, *_), p in zip(rows, prints):
        members.setdefault(least[p], []).append(i)
    first = {g: min((i for i in ids if i is not None), default=None) for g, ids in members.items()}
    want = Counter((i, f"{p:016x}", first[least[p]]) for (i, *_), p in zip(rows, prints))
    for often in (simhash.OFTEN, 1):
        got = simhash.near_groups(docs, often=often).select("doc_id", simhash.as_hex(F.col("fingerprint")).alias("f"), "component_id")
        assert Counter(map(tuple, got.collect())) == want
    assert len(first) < len(set(prints))  # unlike fingerprints do link
    assert simhash.near_groups(docs.limit(0)).count() == 0


@pytest.mark.parametrize("often", [simhash.OFTEN, 20, 3])
@pytest.mark.parametrize("place", ["low", "high", "strewn"])
def test_links_within_dense_groups(spark, place, often):
    rng = np.random.default_rng(3)
    free = {"low": range(14), "high": range(48, 62), "strewn": range(1, 64, 5)}[place]
    masks = np.array([1 << i for i in free], dtype=object)
    dense = {int((masks * (rng.random(len(masks)) < 0.3)).sum()) ^ 0x5A5A5A5A5A5A5A5A for _ in range(900)}
    apart = {int(x) for x in rng.integers(0, 2**63, 300)}
    pairs = {x ^ 1 << int(i) ^ 1 << int(j) for x, (i, j) in zip(apart, rng.integers(0, 64, (300, 2)))}
    prints = sorted(dense | apart | pairs | {0, 2**64 - 1, 2**64 - 4, 3})
    signed = [(p - 2**64 if p >= 2**63 else p,) for p in prints]
    nodes = spark.createDataFrame(signed, "fingerprint LONG")
    links = simhash.linked_fingerprints(nodes, often)
    least = groups_brute(prints)
    want = {}
    for p in prints:
        want.setdefault(least[p], set()).add(p)
    got = {}
    for r in components(links).collect():
        got.setdefault(r.component, set()).add(r.node % 2**64)
    assert {frozenset(x) for x in got.values()} == {frozenset(x) for x in want.values() if len(x) > 1}


def test_keys_of_frequent_segments_stay_small(spark):
    # 4,096 fingerprints of one segment value: no key may hold more than twice the bound or what 47 fixed bits leave
    nodes = spark.range(4096).select((F.col("id") * 1048573).alias("fingerprint"))
    keys = simhash.segment_keys(nodes.select(F.col("fingerprint").bitwiseAND(0xFFFFFFFF).alias("fingerprint")).distinct(), often=50)
    assert keys.groupBy("key").count().agg(F.max("count")).first()[0] <= 200
