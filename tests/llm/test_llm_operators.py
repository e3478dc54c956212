"""Each operator against a brute-force version on small tables with nulls, empty and long texts, ties and repeats."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteflux.llm import chat, common, cotrain, jaccard, lattice, licenses, lines, mixing, packing, rules, topk
from siteflux.sources.sinks import scratch_dir

DOCS = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def make(rows):
    return [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows]


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(5)
    vocab = ["".join(rng.choice(list("abcdefgh"), rng.integers(3, 9))) for _ in range(400)]
    base = [" ".join(rng.choice(vocab, rng.integers(60, 110))) for _ in range(25)]
    rows = [(i, t, "ab"[i % 2]) for i, t in enumerate(base)]
    for i in range(25, 55):  # near copies: a word or two changed
        words = base[i % 5].split()
        for _ in range(1 + i % 3):
            words[rng.integers(len(words))] = "x%d" % rng.integers(1000)
        rows.append((i, " ".join(words), "c"))
    rows += [(60 + i, base[7], "ab"[i % 2]) for i in range(12)]  # copies
    rows += [(80, None, "a"), (81, "", None), (82, " \t\n", "a"), (83, "one two", "b"), (84, "One  TWO", "b"), (85, "Only", None)]
    rows += [(None, base[3], "a"), (86, base[9], "b"), (86, base[9], "b"), (87, base[2] + "\n" + base[4], "c")]
    rows += [(88, "\n".join([base[1], "short", base[6], base[1]]), "a"), (89, " ".join(base) * 4, "a")]
    rows += [(90, "Été 日本 \U0001d518 café\x1cx y  a\n\n b ", "d")]
    return make(rows)


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS)


class Sets:
    def __init__(self, n):
        self.parent = list(range(n))

    def find(self, i):
        while self.parent[i] != i:
            i = self.parent[i]
        return i

    def join(self, i, j):
        i, j = self.find(i), self.find(j)
        self.parent[max(i, j)] = min(i, j)


# --- mixing ---------------------------------------------------------------------------------------------------------


def targets(sizes):
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in fixed]
        left, share = total - sum(fixed.values()), sum(weight[s] for s in rest)
        over = [s for s in rest if left * weight[s] / share > 3 * sizes[s]]
        if not over:
            return fixed | {s: left * weight[s] / share for s in rest}
        fixed |= {s: 3 * sizes[s] for s in over}


def test_mixing_takes_each_sources_budget(spark, corpus):
    docs = frame(spark, corpus)
    rows = mixing.mix_amounts(docs).collect()
    assert len(rows) == len(corpus)
    sizes = Counter()
    for _, text, _, source, _ in corpus:
        sizes[source] += len(WORD.findall(text or ""))
    want = targets(dict(sizes))
    taken = Counter()
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size and r.source_size == sizes[r.source]
        assert math.isclose(r.target, want[r.source], abs_tol=1e-6)
        taken[r.source] += r.taken
    copies = 2  # rows that share a cut round down
    assert all(abs(taken[s] - want[s]) <= 1 + copies for s in sizes)
    assert Counter(rows) == Counter(mixing.mix_amounts(docs.repartition(7)).collect())


def test_mix_emits_what_was_taken(spark, corpus):
    docs = frame(spark, corpus).withColumn("_key", F.lit(1)).withColumn("epochs", F.lit("e"))
    out = mixing.mix(docs)
    assert out.columns == docs.columns and out.where("epochs <> 'e' OR _key <> 1").isEmpty()
    amounts = Counter()
    for r in mixing.mix_amounts(docs).collect():
        amounts[r.doc_id] += r.taken
    words = Counter()
    texts = {}
    for i, t, *_ in corpus:
        texts.setdefault(i, []).append(t or "")
    for r in out.collect():
        words[r.doc_id] += len(WORD.findall(r.text or ""))
        assert any(t.startswith(r.text or "") for t in texts[r.doc_id]) and (r.text is None or r.n_chars == len(r.text))
    assert {k: v for k, v in words.items() if v} == {k: v for k, v in amounts.items() if v}


def test_mixing_of_nothing(spark):
    empty = frame(spark, [])
    assert mixing.mix_amounts(empty).count() == 0 and mixing.mix(empty).count() == 0
    blank = frame(spark, make([(1, None, "a"), (2, "", "b")]))
    assert {r.taken for r in mixing.mix_amounts(blank).collect()} == {0} and mixing.mix(blank).count() == 0


# --- lines ----------------------------------------------------------------------------------------------------------


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def line_brute(spark, rows):
    hashed = frame(spark, rows).select("doc_id", F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
    where = {}
    for r in hashed:
        for k, line in enumerate(r.t.split("\n")):
            words = [w for w in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", line.lower()) if w]
            if len(words) >= lines.MIN_WORDS:
                where.setdefault(" ".join(words), set()).add((r.doc_id is None, r.doc_id or 0, r.h, k))
    names = list(where)
    words = spark.createDataFrame([(w,) for w in {w for n in names for w in n.split(" ")}], "w STRING")
    bits = {r.w: r.h & (2**64 - 1) for r in words.select("w", F.xxhash64("w").alias("h")).collect()}

    def simhash(name):
        own = [bits[w] for w in name.split(" ")]
        return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in own) > len(own))

    hashes, sets = [simhash(n) for n in names], Sets(len(names))
    for i in range(len(names)):
        for j in range(i):
            longest = max(len(names[i]), len(names[j]))
            if (hashes[i] ^ hashes[j]).bit_count() <= 3 and longest <= lines.EDIT_CHARS:
                if edits(names[i], names[j]) <= math.floor(longest * (1 - lines.SIMILARITY)):
                    sets.join(i, j)
    groups = {}
    for i, n in enumerate(names):
        groups.setdefault(sets.find(i), set()).update(where[n])
    gone = {}
    for places in groups.values():
        for p in places - {min(places)}:
            gone.setdefault((None if p[0] else p[1], p[2]), set()).add(p[3])
    return {k: sorted(v) for k, v in gone.items()}


def test_line_dedup_against_brute_force(spark, corpus):
    got = {(r.doc_id, r.text_hash): r.removed for r in lines.removed_lines(frame(spark, corpus)).collect()}
    assert got == line_brute(spark, corpus) and got


def test_dedup_lines_keeps_the_rest(spark):
    shared = "this very line stands in both documents"
    rows = make([(1, f"first one here\n{shared}", "a"), (2, f"{shared}\nsecond one here\n\nok", "a"), (3, shared, "a"), (4, None, "a"), (5, "", "b")])
    docs = frame(spark, rows).withColumn("removed", F.lit(1)).withColumn("given", F.lit(1))
    out = {r.doc_id: (r.text, r.n_chars) for r in lines.dedup_lines(docs).collect()}
    second = "second one here\n\nok"
    assert out == {1: (rows[0][1], len(rows[0][1])), 2: (second, len(second)), 4: (None, None), 5: ("", 0)}
    assert lines.dedup_lines(frame(spark, [])).count() == 0


@pytest.mark.parametrize("n", [1, 10**5, 10**9, 10**13])
def test_block_masks_find_every_near_hash(n):
    masks = [m & (2**64 - 1) for m in lines.block_masks(n)]
    rng = np.random.default_rng(1)
    for _ in range(300):
        flip = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
        assert any(not flip & m for m in masks)


def changed(rng, text, n):
    """``text`` with a run of about ``n`` characters in the middle replaced by others."""
    at = int(rng.integers(len(text) // 4, len(text) // 2))
    return text[:at] + "".join(rng.choice(list("klmnop"), n)) + text[at + n :]


def test_line_dedup_finds_near_lines_of_every_similarity(spark):
    rng = np.random.default_rng(11)
    texts = []
    for _ in range(60):
        base = " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(3, 9))) for _ in range(int(rng.integers(8, 40))))
        texts += [base, changed(rng, base, max(1, int(len(base) * rng.choice([0.04, 0.1, 0.14, 0.18]))))]
    near = 0
    for a, b in zip(texts[::2], texts[1::2]):
        near += 5 * edits(" ".join(a.split()), " ".join(b.split())) <= max(len(a), len(b))
    gone = lines.removed_lines(frame(spark, make([(i, t, "a") for i, t in enumerate(texts)])), distance=None).collect()
    assert near > 50 and {r.doc_id % 2 for r in gone} == {1} and 0.9 * near <= len(gone) <= near


def test_long_lines_and_ties_are_compared_by_edits(spark):
    rng = np.random.default_rng(12)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(900)]
    other = [("z" + w[1:]) if i % 4 == 0 else w for i, w in enumerate(words)]  # 225 edits in 6,299 characters
    mixed = [words[i] for i in rng.permutation(900)]
    assert len(" ".join(words)) > lines.EDIT_CHARS
    tie = "abcd efgh ijkl mnop q r s"  # 25 characters; 5 edits are 0.8
    texts = [" ".join(words), " ".join(mixed), " ".join(other), tie, tie[:-5] + "v w x", tie[:14] + "zzzzzz" + tie[20:]]
    assert edits(tie, texts[4]) == 3 and len(tie) == 25
    texts[4] = "abcd efgh ijkl mnop " + "vwxyz"
    assert edits(tie, texts[4]) == 5 and edits(tie, texts[5]) == 6
    gone = lines.removed_lines(frame(spark, make([(i, t, "a") for i, t in enumerate(texts)])), distance=None).collect()
    assert {r.doc_id for r in gone} == {2, 4}


def test_short_and_unspaced_lines_take_part(spark):
    han = "".join(chr(0x4E00 + 37 * i % 5000) for i in range(60))
    texts = ["ok", "OK.", "page one", "page one", han, han[:30] + "x" + han[31:], han, "abcdefghi", "abcdefgh", "abcd", "abce", "...", "..."]
    gone = lines.removed_lines(frame(spark, make([(i, t, "a") for i, t in enumerate(texts)])), distance=None).collect()
    assert {r.doc_id for r in gone} == {1, 3, 5, 6, 8}


# --- top k ----------------------------------------------------------------------------------------------------------


def test_top_k_with_ties_nulls_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 64)
    monkeypatch.setattr(topk, "GROUP_QUERIES", 2)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).astype(float).tolist()) for i in range(0, 300, 2)]
    rows += [(i, [0.5] * 8) for i in range(1, 200, 2)]  # a vector that many share
    rows += [(0, [0.5] * 8), (400, None), (500, [1.0, None] * 4), (600, [float("nan")] * 8), (601, [float("inf")] * 8), (602, [1.0, 2.0]), (None, [1.0] * 8)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<DOUBLE>"), lambda i: i % 100 == 0, k=10).collect()
    ok = [(i, np.array([math.floor(1024 * x) for x in v] + [0] * (8 - len(v)))) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for n, (i, v) in enumerate(ok):
        if i % 100 == 0:
            best = sorted(((-int(v @ w), j) for m, (j, w) in enumerate(ok) if m != n))[:10]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_top_k_of_few_and_none(spark):
    kind = "vec_id LONG, embedding ARRAY<FLOAT>"
    few = topk.top_k(spark.createDataFrame([(0, [1.0]), (1, [2.0])], kind), lambda i: i == 0)
    assert list(map(tuple, few.collect())) == [(0, 1, 1, 1024 * 2048)]
    assert topk.top_k(spark.createDataFrame([], kind), lambda i: i == 0).count() == 0


# --- packing --------------------------------------------------------------------------------------------------------


def test_packing_round_trip(spark, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    extra = make([(200 + i, t, "z") for i, t in enumerate(["a  b", "a\n b", "a \n b", " a", "a ", "x  y", "it's <|endoftext|> 12 3", "   "])])
    rows = corpus + extra
    out = packing.pack_documents(frame(spark, rows), ids=True).collect()
    want = Counter()
    for i, text, *_ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()), tuple(ids[a:b])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in out) == want
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
        assert sum(n for _, n in parts) <= 1024
    assert packing.pack_documents(frame(spark, [])).count() == 0


def test_rounds_of_packing_waste_little(spark):
    sizes = np.random.default_rng(2).integers(1, 1025, 6000).tolist()
    parts = common.keep(spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "id LONG, length INT"), "parts")
    out = packing.pack(parts, merge_rows=500).collect()
    used = Counter()
    for r in out:
        used[r.sequence_id] += r.length
    assert len(out) == 6000 and max(used.values()) <= 1024
    assert len(used) <= 1.05 * max(sum(sizes) / 1024, sum(s > 512 for s in sizes)) + 2


def test_top_k_of_very_long_vectors(spark):
    rows = [(0, [2.0**20 + 3, 0.0]), (1, [2.0**21, 1.0]), (2, [-1.0, 0.5]), (100, [-(2.0**15), 7.0]), (3, [0.25, 0.25]), (4, [0.0, float("inf")])]
    out = topk.top_k(spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<DOUBLE>"), lambda i: i % 100 == 0, k=10).collect()
    vecs = {i: [math.floor(1024 * x) for x in v] for i, v in rows[:-1]}
    want = []
    for q in (0, 100):
        scored = sorted((-sum(x * y for x, y in zip(vecs[q], v)), i) for i, v in vecs.items() if i != q)
        want += [(q, at, i, -score) for at, (score, i) in enumerate(scored, 1)]
    assert sorted(map(tuple, out)) == want
    huge = spark.createDataFrame([(0, [1e30]), (1, [1e30])], "vec_id LONG, embedding ARRAY<DOUBLE>")
    with pytest.raises(ValueError, match="64 bits"):
        topk.top_k(huge, lambda i: i % 100 == 0)


# --- jaccard --------------------------------------------------------------------------------------------------------


def jaccard_brute(rows, words, percent):
    sets = []
    for _, text, *_ in rows:
        w = WORD.findall(lowered(text))
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    groups = Sets(len(rows))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                groups.join(i, j)
    ids = {}
    for i, r in enumerate(rows):
        ids.setdefault(groups.find(i), []).append(r[0])
    smallest = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return Counter((r[0], len(sets[i]), smallest[groups.find(i)]) for i, r in enumerate(rows))


@pytest.mark.parametrize(("words", "percent", "pivots"), [(4, 85, 3), (5, 80, 1), (1, 50, 1)])
def test_jaccard_groups_against_brute_force(spark, corpus, monkeypatch, words, percent, pivots):
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    monkeypatch.setattr(jaccard, "PIVOTS", pivots)
    out = jaccard.near_groups(frame(spark, corpus), words, percent).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, out)) == jaccard_brute(corpus, words, percent)


def test_one_per_group(spark, corpus):
    docs = frame(spark, corpus).withColumn("gone", F.lit(1)).withColumn("component", F.lit(1))
    out = jaccard.one_per_group(docs, 4, 85)
    kept = [tuple(r) for r in out.collect()]
    assert out.columns == docs.columns
    want = jaccard_brute(corpus, 4, 85)
    empty = sum(n for (_, size, _), n in want.items() if not size)
    assert len(kept) == empty + len({c for _, size, c in want if size})
    assert jaccard.one_per_group(frame(spark, []), 4, 85).count() == 0


def thue_morse(order):
    word = "a"
    for _ in range(order):
        word += word.translate(str.maketrans("ab", "ba"))
    return word


def test_patterned_words_have_their_own_hashes(spark):
    word = thue_morse(10)
    other = word.translate(str.maketrans("ab", "ba"))
    texts = [f"one two {word} three four", f"one two {other} three four", f"three two {word} one four", word, other, word + other, f"{word} {other}"]
    sets = [jaccard.Shingler(4)(t).tolist() for t in texts]
    assert len({h for s in sets for h in s}) == sum(map(len, sets)) == 10
    rows = [(i, t, "s", "en", len(t)) for i, t in enumerate(texts)]
    out = jaccard.near_groups(frame(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, out)) == jaccard_brute(rows, 4, 85)


def test_hashes_do_not_depend_on_chunks(monkeypatch):
    text = " ".join(f"Word{i % 97} x" for i in range(500))
    whole = jaccard.Shingler(4)(text).tolist()
    monkeypatch.setattr(jaccard, "CHUNK_BYTES", 7)
    assert jaccard.Shingler(4)(text.lower()).tolist() == whole
    assert len(whole) == len({tuple(text.lower().split()[i : i + 4]) for i in range(997)})


def test_only_results_stay_in_the_shared_folder(spark, corpus, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "scratch_dir", lambda spark: scratch_dir(spark, str(tmp_path)))
    docs = frame(spark, corpus)
    assert jaccard.near_groups(docs).count() == len(corpus)
    assert [p.name for p in tmp_path.glob("*/*")] == ["jaccard_documents"]
    assert jaccard.one_per_group(docs).count() > 0
    assert sorted(p.name for p in tmp_path.glob("*/*")) == ["jaccard_documents", "jaccard_marked"]
    with pytest.raises(ZeroDivisionError), common.temporary_tables(spark):
        common.keep(docs, "lost")
        raise ZeroDivisionError
    assert len(list(tmp_path.iterdir())) == 2


# --- classifier -----------------------------------------------------------------------------------------------------


def test_classifier_on_held_out_rows(spark):
    rng = np.random.default_rng(4)
    good, bad = ["g%d" % i for i in range(60)], ["b%d" % i for i in range(60)]
    rows, labels = [], []
    for i in range(600):
        fine = i % 3 > 0
        own = rng.choice(good if fine else bad, 8).tolist() + rng.choice(good + bad, 10).tolist()
        rows.append((i, " ".join(own), "en", "s%d" % (i % 4), 100))
        if i % 2 == 0:
            labels.append((i, int(fine), 0))
    labels += [(1, None, None), (2, 0, 0), (None, 1, 0), (10_000, 1, 0)]
    rows += [(None, None, None, None, None), (9, "", "en", "s1", 0)]
    labels = spark.createDataFrame(labels, "doc_id LONG, quality INT, toxic INT")
    out = cotrain.classify(frame(spark, rows).withColumn("y", F.lit("clash")), labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.doc_id is not None and r.doc_id % 2 and r.doc_id != 9]
    assert sum(r.kept == (r.doc_id % 3 > 0) for r in held) > 0.9 * len(held)
    none = cotrain.classify(frame(spark, rows[:3]), labels.where("false")).collect()
    assert all(r.kept and r.score is None for r in none)
    assert cotrain.classify(frame(spark, []), labels).count() == 0


# --- chats ----------------------------------------------------------------------------------------------------------


def test_layouts_become_turns(spark):
    kind = """record STRUCT<prompt STRING, completion STRING, system STRING, instruction STRING, input STRING, output STRING,
        messages ARRAY<STRUCT<role STRING, content STRING>>, conversations ARRAY<STRUCT<`from` STRING, value STRING>>, note STRING>, id INT"""
    empty = dict.fromkeys(["prompt", "completion", "system", "instruction", "input", "output", "messages", "conversations", "note"])
    rows = [
        (empty | {"prompt": "p", "completion": "c", "note": "ignored"}, 1),
        (empty | {"instruction": "i", "output": "o"}, 2),
        (empty | {"system": "s", "instruction": "i", "input": "x", "output": "o"}, 3),
        (empty | {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": None}]}, 4),
        (empty | {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, 5),
        (empty | {"prompt": "p"}, 6),
        (empty, 7),
        (empty | {"messages": []}, 8),
    ]
    out = chat.format_chats(spark.createDataFrame(rows, kind))
    got = {r.id: r.turns if r.turns is None else [tuple(t) for t in r.turns] for r in out.collect()}
    assert got[1] == [("user", "p"), ("assistant", "c")] and got[2] == [("user", "i"), ("assistant", "o")]
    assert got[3] == [("system", "s"), ("user", "i"), ("user", "x"), ("assistant", "o")]
    assert got[4] == [("user", "q"), ("assistant", "")] and got[5] == [("user", "q"), ("assistant", "a")]
    assert got[6] is None and got[7] is None and got[8] == []


def test_chat_round_trip(spark):
    hard = ["<|im_end|>", "<\\|", "<\\\\|im_start|>x\n", "", "<", "<<||", "日\U0001d518\n", "a" * 5000, None]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(hard)]
    rows += [(2, None, None, "n"), (2, 1, "odd\nrole <|", "t"), (2, 1, "assistant", "u"), (None, 0, "assistant", "z")]
    data = spark.createDataFrame(rows, "conv_id LONG, turn LONG, role STRING, text STRING")
    out = chat.format_chats(chat.conversation_records(data))
    out = out.select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("back"), chat.learnt_text(F.col("formatted"), F.col("loss_spans")).alias("learnt"))
    got = {r.conv_id: ([tuple(t) for t in r.back], r.learnt) for r in out.collect()}
    assert got[1] == ([(r[2], r[3] or "") for r in rows[:9]], "".join(r[3] or "" for r in rows[:9] if r[2] == "assistant"))
    assert got[2] == ([("", "n"), ("assistant", "u"), ("odd\nrole <|", "t")], "u") and got[None] == ([("assistant", "z")], "z")
    assert chat.format_chats(chat.conversation_records(data.where("false"))).count() == 0


# --- licences -------------------------------------------------------------------------------------------------------


def test_licences_against_brute_force(spark, corpus):
    notice = licenses.TEMPLATES[0][1].split()
    texts = ["MIT License.\nApache\nLicense mit license mit license", " ".join(notice), " ".join(notice[:-4]), " ".join(notice[: len(notice) // 2]), "CC-BY 4.0 émit license", "commit license"]
    rows = corpus + make([(300 + i, t, "l") for i, t in enumerate(texts)])
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for r, (i, text, *_) in zip(licenses.scan_licenses(frame(spark, rows).coalesce(1)).collect(), rows):
        words = word.findall(lowered(text))
        places = sorted((k, label) for p, label in licenses.PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split())
        found = set()
        for n, line in enumerate(lowered(text).split("\n")):
            block = set(word.findall(line))
            for t, (_, template) in enumerate(licenses.TEMPLATES):
                own = set(template.split())
                if 100 * len(own & block) >= licenses.PERCENT * len(own):
                    found.add((n, t, len(own & block) / len(own)))
        assert r.doc_id == i and r.n_words == len(words) and sorted((p.word, p.label) for p in r.phrases) == places
        assert {(b.line, b.template, b.containment) for b in r.blocks} == found
        assert r.score == (1.0 if places else max((c for *_, c in found), default=0.0))
    assert licenses.scan_licenses(frame(spark, [])).count() == 0


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// "])
def test_wrapped_licences_against_brute_force(spark, mark):
    texts = []
    for _, template in licenses.TEMPLATES:
        words = template.split()
        notice = [mark + " ".join(words[i : i + 7]) for i in range(0, len(words), 7)]
        texts += ["\n".join(["code here", "", *notice, "", "more code"]), "\n".join(notice[: len(notice) // 2])]
    rows = make([(i, t, "a") for i, t in enumerate(texts)])
    for r in licenses.scan_licenses(frame(spark, rows)).collect():
        got, want = {b.template: b.containment for b in r.blocks}, {}
        words = re.findall(r"[a-z0-9]+", texts[r.doc_id])
        for t, (_, template) in enumerate(licenses.TEMPLATES):
            own, size = set(template.split()), math.ceil(len(template.split()) * licenses.WINDOW / 100)
            best = max(len(own & set(words[k : k + size])) for k in range(len(words)))
            if 100 * best >= licenses.PERCENT * len(own):
                want[t] = best / len(own)
        assert got.keys() == want.keys() and (r.doc_id % 2 or got[r.doc_id // 2] == 1)


# --- language model -------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("head", [5, 1 << 17])
def test_base_scores_and_lattice(spark, corpus, head):
    out = lattice.score_texts(frame(spark, corpus), head_words=head).collect()
    texts = [(i, WORD.findall(lowered(t)) + ["\n"]) for i, t, *_ in corpus]
    fold = [zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i, _ in texts]
    counts = Counter(w for (_, ws), out_ in zip(texts, fold) if not out_ for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = Counter((i, h, len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 6)) for (i, ws), h in zip(texts, fold))
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == want
    assert all(-1e9 < r.score < 0 for r in out)
    assert lattice.score_texts(frame(spark, [])).count() == 0


def test_lattice_sums_all_segmentations():
    model = lattice.Lattice(np.arange(32_000), 5)

    def brute(text):
        return 1.0 if not text else sum(math.exp(model.logs[text[:k]]) * brute(text[k:]) for k in range(1, len(text) + 1) if text[:k] in model.logs)

    for word in ("a", "hello", "thexyz"):
        assert math.isclose(model.word(word.encode()), math.log(brute(lattice.SPACE_MARK + word)), rel_tol=1e-9)
    total = sum(map(math.exp, model.logs.values())) + sum(map(math.exp, model.bytes.values())) + math.exp(model.end)
    assert 0.99 < total <= 1 + 1e-9 and math.isfinite(model.word("\U0001d518\udc80".encode("utf-8", "surrogatepass")))
    assert math.isfinite(model.word(b"ab" * 20_000))


# --- rules ----------------------------------------------------------------------------------------------------------


def test_quality_counts_against_brute_force(spark, corpus):
    rows = corpus + make([(400, "a a a a", "r"), (401, "a b c a b c", "r"), (402, "x y\nx y\n\n \nx y", "r"), (403, "#*$%&|<> ok", "r"), (404, "A B " * 60, "r")])
    out = rules.quality_counts(frame(spark, rows)).collect()
    want = Counter()
    for i, text, *_ in rows:
        text = text or ""
        words = WORD.findall(text)
        grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        seen = Counter(grams)
        cover = {k + d for k, g in enumerate(grams) if seen[g] > 1 for d in range(3)}
        own = [line for line in text.split("\n") if WORD.search(line)]
        failed = len(words) < 50 or 100 * len(cover) > 50 * len(words)
        want[i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(own) - len(set(own)), len(cover), failed] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out) == want
    assert all(not (r.base_failed and r.kept) for r in out)
    kept = rules.quality_rules(frame(spark, rows)).where("rejected_by IS NULL").count()
    assert kept == sum(r.kept for r in out) and kept > 20
    assert rules.quality_counts(frame(spark, [])).count() == 0


def test_rules_in_any_order_give_one_verdict(spark, corpus):
    docs = frame(spark, corpus)
    verdicts = [
        [r[0] for r in docs.select(rules.cascade(rules._of_text(common.text_of()), order).isNull().alias("kept")).collect()]
        for order in (rules.RULES, rules.RULES[::-1])
    ]
    assert verdicts[0] == verdicts[1]


# --- groups and pipeline --------------------------------------------------------------------------------------------


def test_components(spark):
    rng = np.random.default_rng(6)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 120, (70, 2))] + [(200 + i, 201 + i) for i in range(30)] + [(5, 5)]
    sets = Sets(300)
    for a, b in pairs:
        sets.join(a, b)
    nodes = {x for a, b in pairs if a != b for x in (a, b)}
    got = {r.node: r.component for r in common.components(spark.createDataFrame(pairs, "a LONG, b LONG")).collect()}
    assert got == {x: sets.find(x) for x in nodes}
    assert common.components(spark.createDataFrame([], "a LONG, b LONG")).count() == 0


def test_pipeline_stages(spark, corpus, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "jaccard_join", "mixing", "packing"]
    path = str(tmp_path / "sf")
    long = [(i, t if t is None else f"{t} tail{i} of{i} it{i}", la, s, n) for i, t, la, s, n in corpus]
    frame(spark, long).write.parquet(f"{path}/documents.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.keep(stage(spark, docs, path), name)
        assert out.columns == docs.columns, name
        docs = out
    words = sum(len(WORD.findall(r.text or "")) for r in docs.collect())
    rows = corpus_pipeline.run(spark, path).collect()
    assert words > 1000 and rows
    assert sum(r.length for r in rows) >= words
    used = Counter()
    for r in rows:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= packing.SEQUENCE
