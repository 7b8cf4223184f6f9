"""Segment alignment, ball hashing and the filter audit against brute force, and on awkward tables."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cellshare.llm import alignment, common, filter_audit, simhash, tokens

from .test_operators import awkward, corpus, rows_of

BYTE, PIECE = tokens.tokenizer_path("byte_bpe_50k.json"), tokens.tokenizer_path("piece_bpe_32k.model")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["  a  b ", "a▁b x", "<|endoftext|> <s> x\n<unk>", "tab\t\there \t x\r\n y  z　 w  v", " lead", "a\n\n b \n", "é́ ́x    u", "🙂 🙂 don't I'll 'll", ".\n;\r )\r\n", " x ​y　 z"]


# ----------------------------------------------------------------------------------------- alignment
def brute_alignment(rows):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_tok, b_tok = Tokenizer.from_file(BYTE), SentencePieceProcessor(model_file=PIECE)
    a_tok.encode_special_tokens = True
    code = {c: b for c, b in alignment._byte_level().items()}
    a_bytes = lambda i: bytes(code[c] for c in a_tok.id_to_token(i))
    b_bytes = lambda i: bytes([int(b_tok.id_to_piece(i)[3:5], 16)]) if b_tok.is_byte(i) else b_tok.id_to_piece(i).replace("▁", " ").encode()
    done, count = [], collections.Counter()
    for d, t in rows:
        a = a_tok.encode(" " + t, add_special_tokens=False).ids if t else []
        b = b_tok.encode(t) if t else []
        ab, bb = [a_bytes(i) for i in a], [b_bytes(i) for i in b]
        if not t or b"".join(ab) != (" " + t).encode() or b"".join(bb) != (" " + t).encode():
            done.append((d, [], [], [], []))
            continue
        ae, be = list(itertools.accumulate(map(len, ab))), list(itertools.accumulate(map(len, bb)))
        links, groups, own, i, j = [], [], ([a[0]], [b[0]]), 0, 0
        while True:
            links.append((a[i], b[j]))
            if ae[i] == be[j]:
                groups.append("|".join(",".join(map(str, x)) for x in own))
                own, i, j = ([], []), i + 1, j + 1
                if i == len(a):
                    break
                own[0].append(a[i])
                own[1].append(b[j])
            elif ae[i] < be[j]:
                i += 1
                own[0].append(a[i])
            else:
                j += 1
                own[1].append(b[j])
        done.append((d, a, b, groups, links))
        count.update(links)
    best = collections.defaultdict(int)
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    sha = lambda g: hashlib.sha256(";".join(g).encode()).hexdigest() if g else ""
    return collections.Counter((d, len(a), len(b), len(g), len(l), sum(count[x] == best[x[1]] for x in l), sum(count[x] for x in l), sha(g)) for d, a, b, g, l in done)


@pytest.mark.parametrize("block", [alignment.BLOCK, 64])
def test_alignment_against_whole_texts(spark, block):
    for df in (awkward(spark), corpus(spark), spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")):
        got = collections.Counter(tuple(r) for r in alignment.align(df, BYTE, PIECE, block=block).collect())
        assert got == brute_alignment(rows_of(df))


def test_alignment_of_random_white_space(spark):
    rng = random.Random(5)
    bits = [" ", "  ", "\n", "\t", "\r\n", " ", "　", "a", "Word", "12", "...", "é", "▁", "'s", "日本", "\x1c", "\x0b"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(1, 30)))) for i in range(300)]
    got = collections.Counter(tuple(r) for r in alignment.align(spark.createDataFrame(rows, "doc_id long, text string"), BYTE, PIECE).collect())
    assert got == brute_alignment(rows)


def test_no_vocabulary_entry_holds_a_cut(spark):
    pair = alignment.Pair(BYTE, PIECE)
    assert [b for b in range(256) if pair.starters[b]] == [9, 10, 32]
    # an entry such as "x y" forbids cutting before a space
    assert not alignment.cuttable([b"x y"], [b"ab"])[32] and not alignment.cuttable([], [b" \n"])[10]


def test_groups_come_whole(spark):
    df = spark.createDataFrame([(1, "hello wörld"), (2, "")], "doc_id long, text string")
    whole = {r.doc_id: r.groups_sha256 for r in alignment.align(df, BYTE, PIECE, whole=True).collect()}
    digest = {r.doc_id: r.groups_sha256 for r in alignment.align(df, BYTE, PIECE).collect()}
    assert whole[2] == digest[2] == "" and hashlib.sha256(whole[1].encode()).hexdigest() == digest[1]


def test_packed_numbers_round_trip():
    numbers = np.array([0, 1, 127, 128, 16383, 16384, 2**21, 2**28 + 5, 2**31 - 1])
    raw, at = alignment._packed(numbers)
    assert alignment._unpacked(raw.tobytes()).tolist() == numbers.tolist() and at[-1] == len(raw)
    assert alignment._unpacked(b"").tolist() == []


def test_alignment_of_an_empty_table(spark):
    assert alignment.align(awkward(spark).limit(0), BYTE, PIECE).count() == 0


# ------------------------------------------------------------------------------------------- simhash
def brute_simhash(rows, radius):
    prints = []
    for _, t in rows:
        w = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        s = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    return [(d, p) for (d, _), p in zip(rows, prints, strict=True)], brute_components(prints, [d for d, _ in rows], radius)


def brute_components(prints, ids, radius):
    f, label = np.array(prints, np.uint64), list(range(len(prints)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i] ^ f) <= radius).tolist():
            x, y = sorted((find(i), find(j)))
            label[y] = x
    least = {}
    for k, d in enumerate(ids):
        if d is not None:
            least[find(k)] = min(least.get(find(k), d), d)
    return [least.get(find(k)) for k in range(len(f))]


@pytest.mark.parametrize("most", [simhash.MOST, 3000])
def test_simhash_against_all_pairs(spark, most):
    for df in (awkward(spark), corpus(spark)):
        rows = rows_of(df)
        prints, component = brute_simhash(rows, 4)
        want = collections.Counter((d, format(p, "016x"), c) for (d, p), c in zip(prints, component, strict=True))
        out = simhash.near_duplicates(df, most=most)
        assert out.columns == ["doc_id", "fp", "fingerprint", "component_id"]
        assert collections.Counter((r.doc_id, r.fingerprint, r.component_id) for r in out.collect()) == want


@pytest.mark.parametrize("most", [1 << 20, 2500])
def test_links_of_crowded_fingerprints(spark, most):
    """Fingerprints at all small distances, most of them in one ball: components as by all pairs, no more links than nodes."""
    rng = random.Random(7)
    flip = lambda p, k: p ^ sum(1 << b for b in rng.sample(range(64), k))
    hot, prints = rng.getrandbits(64), set()
    for _ in range(150):
        prints.add(flip(hot, rng.randrange(0, 9)))
        base = rng.getrandbits(64)
        prints |= {base, flip(base, rng.randrange(3, 7))}
    prints = sorted(prints)
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    for radius in (2, 4):
        found = [(r.a & 2**64 - 1, r.b & 2**64 - 1) for r in simhash.links(df, radius, most).collect()]
        label = {p: p for p in prints}

        def find(x, label=label):
            while label[x] != x:
                x = label[x]
            return x

        for a, b in found:
            x, y = sorted((find(a), find(b)))
            label[y] = x
        assert [find(p) for p in prints] == brute_components(prints, prints, radius)


def test_an_odd_radius_is_refused(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.range(2).withColumnRenamed("id", "fp"), radius=3)


def test_simhash_of_an_empty_table(spark):
    assert simhash.near_duplicates(awkward(spark).limit(0)).count() == 0


def test_a_hot_key_joins_without_its_shuffle(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"))
    side = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    out = common.spread_join(common.materialise(rows), common.materialise(side), "k")
    assert out.filter("v <> 2 * k or v is null").count() == 0 and out.count() == 5000
    none = common.spread_join(common.materialise(rows.withColumn("k", F.lit(None).cast("long"))), side, "k")
    assert none.count() == 5000 and none.filter("v is not null").count() == 0


# -------------------------------------------------------------------------------------- filter audit
def brute_audit(rows, labels):
    """``rows``: id, text, source."""
    first, good, toxic = {}, {d for d, q, _ in labels if q == 1} - {None}, {d for d, _, t in labels if t == 1} - {None}
    for d, t, _ in rows:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    parts = collections.defaultdict(list)
    for d, t, s in rows:
        t = t or ""
        w, bad = WORDS.findall(t), set()
        bad |= {"A"} if len(w) < 200 else set()
        bad |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        bad |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t) else set()
        bad |= {"D"} if set(t) & set("#$%&*|") else set()
        bad |= {"E"} if d is not None and d > first[t] else set()
        parts[s or ""].append((bad, d in good, d in toxic))
    out = {}
    for part, docs in parts.items():
        share = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = docs
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                share[f] += len(gone)
                early = sum(f in x[0] and bool(x[0] & set(order[:k])) for x in docs)
                out[part, "".join(order), k + 1] = [len(left), len(gone), early, sum(x[0] == {f} for x in docs), sum(x[1] for x in gone), sum(x[2] for x in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(share[order[step - 1]])
    return out


def test_filter_audit_against_brute_force(spark):
    rng = random.Random(9)
    words = ["a", "B", "cc", "DD$", "e|", "#", "naïve", "Word"]
    long = " ".join(f"w{i}" for i in range(220))
    rows = [(i, "".join(rng.choice(words) + rng.choice([" ", "\n", "  "]) for _ in range(rng.choice([0, 3, 150, 260]))), rng.choice(["x", "y", "", None])) for i in range(60)]
    rows += [(100 + i, rng.choice([long, long + " $", "\t" + long.upper(), "", None]), rng.choice(["x", "z"])) for i in range(40)]
    rows += [(101, long, "x"), (101, long, "x"), (101, "other", "y"), (None, long, "z"), (None, None, None), (0, None, "x"), (0, "", "x")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 140, 2)] + [(4, 1, 0), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit("clash") for c in ("i", "h", "n", "part", "word", "quality", "toxic", "same")})
    out = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash")))
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in out.collect()}
    assert got == brute_audit(rows, labels)
    assert filter_audit.audit(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0
