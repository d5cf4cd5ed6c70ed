"""Each operator against a plain version, and the cases that every operator has to handle."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.llm import decontamination, language_id, licenses, ngram_join, packing, pii, quality, token_counts, tokens, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"{a}{b}{c}" for a in ("th", "er", "on", "an", "re", "ou") for b in ("a", "e", "i", "o") for c in ("st", "nd", "ble", "tion", "ing", "ly")]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def frame(spark, texts, langs=None, extra=False):
    rows = [(i, t, (langs or ["en"] * len(texts))[i], f"src{i % 2}", None if t is None else len(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    if extra:  # names that the operators use themselves
        for c in ("row_id", "node", "score", "whole_text", "shard", "toxicity", "leak_score", "clean_text", "spans"):
            df = df.withColumn(c, F.lit("x"))
    return df


def odd_texts(rng):
    """Nulls, empty and blank texts, no letters, ties, repeats, surrogate-free odd characters, and a very long one."""
    same = sentence(rng, 40)
    return [None, "", " \n\t ", "42 #$%", same, same, "naïve ﬁ ǅ ß Σίσυφος 𝔘𝔫𝔦 漢字 İstanbul", "x", sentence(rng, 25_000), "a b c", "<|endoftext|> it's"]


# --- licences


def plain_canonical(text):
    t = re.sub(r"\r\n?", "\n", (text or "").lower())
    t = re.sub(licenses.COPYRIGHT_LINE, r"\1", t)
    t = re.sub(r"[^a-z0-9\n]+", " ", t)
    for a, b in licenses.SPELLINGS.items():
        t = re.sub(rf"\b{a}\b", b, t)
    return [x.strip() for x in t.split("\n") if x.strip()]


def test_licences_whatever_their_form(spark):
    mit = licenses.FULL_TEXTS["MIT"]
    changed = mit.replace("<year> <copyright holders>", "2031 Somebody Else, all of them").upper().replace(",", " ;").replace("\n\n", "\r\n\r\n")
    isc = licenses.FULL_TEXTS["ISC"].replace("ISC License", "ISC Licence")
    texts = [mit, changed, isc, mit + " more", "Prose.\nreleased under the MIT licence\nProse.", "Released under the MIT License.", None, ""]
    got = {r["doc_id"]: r for r in licenses.scan(frame(spark, texts), licenses.catalog(spark)).collect()}
    assert [got[i]["text_license"] for i in range(8)] == ["MIT", "MIT", "ISC", None, None, "MIT", None, None]
    assert [got[i]["line_licenses"] for i in (4, 5, 6)] == ["MIT", "MIT", ""]
    import hashlib

    assert all(got[i]["text_digest"] == hashlib.sha256(" ".join(plain_canonical(t)).encode()).hexdigest() for i, t in enumerate(texts))


def test_licences_of_odd_texts(spark):
    texts = odd_texts(random.Random(1))
    got = licenses.scan(frame(spark, texts, extra=True), licenses.catalog(spark))
    assert got.count() == len(texts)
    assert licenses.scan(frame(spark, texts).limit(0), licenses.catalog(spark)).count() == 0
    twice = frame(spark, texts).union(frame(spark, texts))
    assert licenses.scan(twice, licenses.catalog(spark)).count() == 2 * len(texts)


# --- tokens, packing and counts


def test_pieces_have_the_ids_of_whole_texts():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokens.default_path())
    rng = random.Random(2)
    texts = [*odd_texts(rng)[1:], "don't can't I'll ll's 's", "a1b2 1,000.5% --x-- (y)!! ...", "É é Å Å ﬀ", "ΣΑΣ ΌΣΟΣ", "𝕏y ​z 　w", "<|startoftext|>x<|endoftext|>y"]
    alphabet = "abcdefgh ABC.,!'-é0 1\nß<|>"
    texts += ["".join(rng.choice(alphabet) for _ in range(60)) for _ in range(300)] + [sentence(rng, 50) for _ in range(50)]
    encode = tokens.encoder(tokens.default_path()).encode
    for t in texts:
        assert np.frombuffer(encode(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t[:80]


def brute_fill(counts, room):
    best = 0
    reach = {0}
    for n, c in counts.items():
        reach |= {r + n * k for r in reach for k in range(1, c + 1) if r + n * k <= room}
        best = max(reach)
    return best


def test_fill_is_closest_to_the_window():
    rng = random.Random(3)
    for _ in range(200):
        counts = {rng.randint(1, 40): rng.randint(1, 4) for _ in range(rng.randint(1, 7))}
        room = rng.randint(0, 120)
        got = packing.best_fill(counts, room)
        assert all(k <= counts[n] for n, k in got.items())
        assert sum(n * k for n, k in got.items()) == brute_fill(counts, room)


def test_packing_keeps_every_id_once(spark):
    from tokenizers import Tokenizer

    rng = random.Random(4)
    texts = [*odd_texts(rng), *[sentence(rng, rng.randint(1, 900)) for _ in range(150)]]
    df = frame(spark, texts, extra=True)
    rows = packing.pack(df, shard_items=64).collect()
    whole = Tokenizer.from_file(tokens.default_path())
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(range(len(texts)))
    for i, t in enumerate(texts):
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            assert r["ids_crc32"] == zlib.crc32(ids[at: at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    used = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        used += at
    assert used >= 0.93 * 2048 * len(by_sequence)
    assert packing.pack(df.limit(0)).count() == 0
    assert packing.pack(df.unionByName(df).withColumn("doc_id", F.lit(None).cast("long"))).agg(F.sum("length")).first()[0] == 2 * sum(r["length"] for r in rows)


def test_suffix_sums(spark):
    rng = random.Random(5)
    texts = [*odd_texts(rng), *[sentence(rng, rng.randint(0, 60)) for _ in range(80)]]
    encode = tokens.encoder(tokens.default_path()).encode
    lengths = [len(encode(t)) // 4 for t in texts]
    counts = token_counts.histogram(frame(spark, texts))
    got = token_counts.suffix_report(counts, block=16).collect()
    assert sorted(r["n_tokens"] for r in got) == sorted(set(lengths))
    for r in got:
        n = r["n_tokens"]
        assert (r["n_docs"], r["docs_fitting"], r["docs_longer"]) == (lengths.count(n), sum(x <= n for x in lengths), sum(x > n for x in lengths))
        assert (r["tokens_in_fitting"], r["truncated_tokens"], r["total_tokens"]) == (sum(x for x in lengths if x <= n), sum(min(x, n) for x in lengths), sum(lengths))
    for r in token_counts.limits(counts, [0, 7, 100, 10**6]).collect():
        assert r["truncated_tokens"] == sum(min(x, r["context_limit"]) for x in lengths)
    assert token_counts.suffix_report(token_counts.histogram(frame(spark, texts).limit(0))).count() == 0


# --- near duplicates


def plain_shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    k = min(5, len(w))
    return {tuple(w[i: i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute_near(texts):
    distinct = sorted(set(t or "" for t in texts))
    sets = [plain_shingles(t) for t in distinct]
    near = {i: set() for i in range(len(distinct))}
    for i in range(len(distinct)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if union and len(sets[i] & sets[j]) / union >= 0.8:
                near[i].add(j), near[j].add(i)
    label = {}
    for i in near:
        stack = [i]
        while stack:
            x = stack.pop()
            if x not in label:
                label[x] = i
                stack += near[x]
    return {t: (label[i], len(near[i])) for i, t in enumerate(distinct)}


def edited(rng, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice(WORDS) + "x"
    return " ".join(w)


def test_links_and_classes_equal_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    texts = odd_texts(rng)[:8]
    for _ in range(12):
        base = sentence(rng, rng.randint(30, 200))
        texts += [base, base] + [edited(rng, base, rng.randint(1, 4)) for _ in range(rng.randint(1, 6))]
    common = sentence(rng, 60)
    texts += [f"{common} {sentence(rng, rng.randint(20, 60))}" for _ in range(30)]
    base = sentence(rng, 150)
    texts += [edited(rng, base, 1) for _ in range(60)]
    monkeypatch.setattr(ngram_join, "BUCKET_BLOCK", 16)
    monkeypatch.setattr(ngram_join, "EXACT_BLOCK", 16)
    monkeypatch.setattr(ngram_join, "HOT_COPIES", 2)
    want = brute_near(texts)
    rows = ngram_join.near_duplicates(frame(spark, texts)).collect()
    assert len(rows) == len(texts)
    heads = {}
    for i, t in enumerate(texts):
        heads.setdefault(want[t or ""][0], []).append(i)
    for r in rows:
        label, links = want[texts[r["doc_id"]] or ""]
        assert (r["class_id"], r["n_links"]) == (min(heads[label]), links)
        assert r["n_copies"] == sum((t or "") == (texts[r["doc_id"]] or "") for t in texts)
    kept = ngram_join.keep_one(frame(spark, texts, extra=True))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(min(h) for h in heads.values())
    assert kept.columns == frame(spark, texts, extra=True).columns


def test_join_of_repeats_nulls_and_nothing(spark):
    texts = ["a b c d e f g", None, ""]
    df = frame(spark, texts)
    twice = df.unionByName(df).unionByName(df.withColumn("doc_id", F.lit(None).cast("long")))
    assert ngram_join.near_duplicates(twice).count() == 9
    kept = ngram_join.keep_one(twice).collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in kept) == [(0, texts[0]), (1, "")]
    assert ngram_join.near_duplicates(df.limit(0)).count() == 0
    assert ngram_join.keep_one(df.limit(0)).count() == 0


def test_posterior_table():
    """P(similarity >= 0.8 | m of n) by numeric integration of the Beta posterior."""
    for k, least in enumerate(ngram_join.least_matches(), 1):
        n = k * ngram_join.STEP
        x = np.linspace(0, 1, 200_001)[1:-1]

        def tail(m):
            d = np.exp(m * np.log(x) + (n - m) * np.log1p(-x))
            return d[x >= 0.8].sum() / d.sum()

        assert tail(least) >= ngram_join.TOLERANCE * 0.9 and (least == 0 or tail(least - 1) < ngram_join.TOLERANCE * 1.1)


def test_large_ids_beside_nulls(spark):
    big = (1 << 60) + 1
    df = spark.createDataFrame([(big, "a b c"), (big + 1, "d e f"), (None, "g")], "doc_id long, text string").coalesce(1)
    assert {r["doc_id"] for r in packing.pack(df).collect()} == {r["doc_id"] for r in ngram_join.near_duplicates(df).collect()} == {big, big + 1, None}


# --- decontamination


def plain_align(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            s = 2 if a[i] == b[j] and a[i] else -1
            h[i + 1, j + 1] = max(0, h[i, j] + s, h[i, j + 1] - 1, h[i + 1, j] - 1)
    return h.max()


def test_alignment_equals_plain():
    rng = np.random.default_rng(7)
    for _ in range(100):
        a, b = rng.integers(1, 5, rng.integers(1, 12)), rng.integers(0, 5, rng.integers(1, 30))
        assert decontamination.align(a, b)[0] == plain_align(a, b)


def test_leaks_are_found_and_clean_texts_left(spark):
    rng = random.Random(8)
    items = [sentence(rng, 30) + f" item{i}" for i in range(6)]
    other = [sentence(rng, 80) for _ in range(20)]
    copies = [f"{other[0]} {items[0]} {other[1]}", f"{sentence(rng, 3000)}\n{items[1].upper()}!", edited(rng, items[2], 5), " ".join(items[3].split()[:2] + ["zz"] + items[3].split()[3:])]
    texts = [*copies, *other, None, ""]
    bench = spark.createDataFrame([*enumerate(items), (99, None), (98, ""), (7, items[0])], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontamination.find_leaks(frame(spark, texts), bench).collect()}
    assert [got[i]["item_id"] for i in range(4)] == [0, 1, 2, 3]
    assert not any(got[i]["contaminated"] for i in range(4, len(texts)))
    assert got[0]["score"] == 1.0
    left = decontamination.remove_leaks(frame(spark, texts, extra=True), bench)
    assert sorted(r["doc_id"] for r in left.collect()) == list(range(4, len(texts))) and left.columns == frame(spark, texts, extra=True).columns
    assert decontamination.find_leaks(frame(spark, texts), bench.limit(0)).where("contaminated").count() == 0
    assert decontamination.find_leaks(frame(spark, texts).limit(0), bench).count() == 0


def test_blocks_of_items_change_nothing(spark, monkeypatch):
    rng = random.Random(9)
    items = [sentence(rng, 20) for _ in range(9)]
    texts = [f"{sentence(rng, 30)} {x}" for x in items] + [sentence(rng, 50)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    one = sorted(map(tuple, decontamination.find_leaks(frame(spark, texts), bench).collect()))
    default = decontamination.blocks
    monkeypatch.setattr(decontamination, "blocks", lambda b: default(b, 45))
    assert sorted(map(tuple, decontamination.find_leaks(frame(spark, texts), bench).collect())) == one


# --- toxicity


def toxic_set(rng, n, pairs):
    texts, labels = [], []
    for _ in range(n):
        bad, group = rng.random() < 0.5, rng.random() < 0.5
        w = sentence(rng, rng.randint(20, 60)).split() + ["zounds"] * bad + ["folk"] * group
        rng.shuffle(w)
        texts.append(" ".join(w)), labels.append(int(bad and group) if pairs else int(bad))
    return texts, labels


@pytest.mark.parametrize("pairs", [False, True])
def test_machine_learns_words_and_pairs(pairs):
    rng = random.Random(10)
    machine = toxicity.fit(*toxic_set(rng, 1200, pairs))
    texts, labels = toxic_set(rng, 400, pairs)
    scores = toxicity.Scorer(machine)(texts)[0]
    assert np.mean([(s >= 0.3) == bool(y) for s, y in zip(scores, labels)]) > 0.97


def plain_score(machine, text):
    occ = [machine.place[s] for w in sorted(set(re.findall(r"\w+", (text or "").lower()))) for s in toxicity.slots(w) if s in machine.place]
    z = machine.bias + sum(machine.weight[k] for k in occ) + sum(float(machine.factor[a] @ machine.factor[b]) for i, a in enumerate(occ) for b in occ[:i])
    return 1 / (1 + np.exp(-z))


def test_scores_equal_all_pairs_and_odd_texts(spark):
    rng = random.Random(11)
    texts, labels = toxic_set(rng, 300, False)
    machine = toxicity.fit(texts, labels)
    assert np.allclose(toxicity.Scorer(machine)(texts[:30])[0], [plain_score(machine, t) for t in texts[:30]])
    odd = odd_texts(rng)
    df = frame(spark, [*texts, *odd], extra=True)
    label = spark.createDataFrame([(i, 1, y) for i, y in enumerate(labels)], "doc_id long, quality int, toxic int")
    got = toxicity.detect(df, label).collect()
    assert len(got) == len(texts) + len(odd) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    wrong = [r for r in got if r["doc_id"] < len(labels) and r["predicted"] != labels[r["doc_id"]]]
    assert len(wrong) <= 3
    left = toxicity.remove_toxic(df, label)
    assert left.columns == df.columns and left.count() >= len(odd)
    assert toxicity.detect(df, label.limit(0)).where("score > 0.01").count() == 0
    assert toxicity.detect(df.limit(0), label).count() == 0


# --- quality


def plain_quality(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    wins = [tuple(w[i: i + 8]) for i in range(len(w) - 7)]
    seen = {}
    for x in wins:
        seen[x] = seen.get(x, 0) + 1
    covered = {i + k for i, x in enumerate(wins) if seen[x] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if re.sub(r"[\x20\x09-\x0D]+", "", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_equal_plain(spark):
    rng = random.Random(12)
    part = sentence(rng, 9)
    texts = [*odd_texts(rng), f"{part} {part} {part}", f"{part}\n{part}\nx\n\n \n{part}", "a b c d e f g h " * 30, " ".join([part, sentence(rng, 30), part, sentence(rng, 5), part]), "#*$%&|<> x\n#*$%&|<> x", *[sentence(rng, 60) for _ in range(30)]]
    got = {r["doc_id"]: r for r in quality.filter_quality(frame(spark, texts, extra=True)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r, want = got[i], plain_quality(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, i
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["kept"] and r["base_failed"])
    assert all(got[i]["kept"] for i in range(len(texts) - 30, len(texts)))
    assert quality.filter_quality(frame(spark, texts).limit(0)).count() == 0


def test_sketch_merges_and_stays_close(spark):
    rng = random.Random(13)
    values = [int(rng.paretovariate(0.7)) for _ in range(4000)]
    df = spark.createDataFrame([("g", v, v, v, v) for v in values], "g string, symbol_rate long, dup_line_rate long, repeat_rate long, word_length long")
    halves = [quality.sketch(df.limit(1500), ["g"]), quality.sketch(df.exceptAll(df.limit(1500)), ["g"])]
    whole = quality.sketch(df, ["g"])
    merged = quality.merge(halves[0].unionByName(halves[1]), ["g"])
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, merged.collect()))
    q = quality.quantiles(whole, ["g"]).where("rate = 'word_length'").first()
    exact = sorted(values)
    for name, p in (("low", 0.25), ("mid", 0.5), ("up", 0.75)):
        true = exact[int(np.ceil(len(exact) * p)) - 1]
        assert true * (1 - 1 / 32) <= q[name] <= true


# --- personal data


def numbered_text(rng):
    kinds = [lambda: f"{rng.choice(WORDS)}.{rng.randint(1, 99)}@mail{rng.randint(1, 9)}.example.com", lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)), lambda: f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}", lambda: card(rng)]
    return " ".join(rng.choice(kinds)() if rng.random() < 0.1 else rng.choice(WORDS) for _ in range(80))


def card(rng):
    digits = "4" + "".join(str(rng.randint(0, 9)) for _ in range(14))
    return next(digits + str(d) for d in range(10) if pii.luhn(digits + str(d)))


def test_base_spans():
    text = "a.b+c@x-y.co.uk, 1.2.3.4 x 256.1.1.1 x 1.2.3.4.5 tel +1 (212) 555-8457 x 4111 1111 1111 1111 x 4111111111111112 x +12 34"
    assert [(k, text[a:b]) for k, a, b in pii.base_spans(text)] == [("email", "a.b+c@x-y.co.uk"), ("ip", "1.2.3.4"), ("ip", "1.2.3.4"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (212) 555-8457")]
    assert pii.joined([("phone", 1, 2), ("email", 5, 6), ("email", 3, 4)]) == "email:3:4,email:5:6,phone:1:2"
    assert pii.base_spans(None) == pii.base_spans("") == []


def test_gradients_are_right():
    rng = np.random.default_rng(14)
    p, ids, gold = pii._init(3), rng.integers(0, 20, (7, 3)), rng.integers(0, pii.K, (7, 3))

    def loss():
        e, _ = pii._emissions(p, ids)
        z = pii._marginals(p, e)[2]
        s = p["first"][gold[0]] + sum(np.take_along_axis(e[t], gold[t][:, None], 1)[:, 0] for t in range(7)) + sum(p["move"][gold[t - 1], gold[t]] for t in range(1, 7))
        return float((z - s).mean())

    g = pii._gradients(p, ids, gold)
    for name in p:
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in p[name].shape)
            old = p[name][at]
            p[name][at] = old + 1e-5
            up = loss()
            p[name][at] = old - 1e-5
            down = loss()
            p[name][at] = old
            assert abs((up - down) / 2e-5 - g[name][at]) < 1e-5, (name, at)


def test_tagger_learns_the_spans_and_rows_follow(spark):
    rng = random.Random(15)
    texts = [numbered_text(rng) for _ in range(300)]
    held = [numbered_text(rng) for _ in range(60)]
    tagger = pii.train(*pii.training_windows(texts))
    bases = [pii.base_spans(t) for t in held]
    found = pii.added_spans(held, [[] for _ in held], tagger)
    hit = sum(len(set(a) & set(b)) for a, b in zip(found, bases))
    assert hit >= 0.9 * sum(map(len, bases)) and hit >= 0.9 * sum(map(len, found))
    odd = odd_texts(rng)
    df = frame(spark, [*texts[:40], *odd], extra=True)
    import hashlib

    for r in pii.find(df).collect():
        t = [*texts[:40], *odd][r["doc_id"]]
        base = pii.base_spans(t)
        assert r["base_sha256"] == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        assert set(pii.joined(base).split(",")) - {""} <= set(r["spans"].split(","))
    clean = {r["doc_id"]: r for r in pii.redact(df).collect()}
    assert len(clean) == 40 + len(odd) and pii.redact(df).columns == df.columns
    assert all(not pii.base_spans(clean[i]["text"]) and clean[i]["n_chars"] == len(clean[i]["text"]) for i in range(40))
    assert pii.redacted("ab 12 cd", [("ip", 3, 5), ("card", 3, 4)]) == "ab [IP] cd"
    assert pii.find(df.limit(0)).count() == 0


# --- languages


def test_language_spans_and_accuracy(spark):
    rng = random.Random(16)
    other = [w.replace("th", "sch").replace("i", "ü") + "keit" for w in WORDS]
    make = {"en": WORDS, "de": other}
    texts, langs = [], []
    for _ in range(200):
        lang = rng.choice(["en", "de"])
        texts.append(" ".join(rng.choice(make[lang]) for _ in range(rng.randint(3, 80)))), langs.append(lang)
    odd = odd_texts(rng)
    df = frame(spark, [*texts, *odd], [*langs, *[None] * len(odd)], extra=True)
    got = {r["doc_id"]: r for r in language_id.identify(df).collect()}
    assert len(got) == len(texts) + len(odd)
    assert all(got[i]["lang_pred"] == lang for i, lang in enumerate(langs))
    at = len(texts)
    assert [got[at + i]["lang_pred"] for i in range(4)] == ["und"] * 4 and got[at]["score"] == 0.0
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got.values())
    model = language_id.fit(texts, langs)
    labeller = language_id.Labeller(model)
    mixed = [" ".join(rng.choice(WORDS) for _ in range(30)), " ".join(rng.choice(other) for _ in range(20))]
    w = language_id.words_of([" ".join(mixed)])
    path = [model.languages[k] for k in labeller.path(labeller.word_scores(w))]
    assert path[:29] == ["en"] * 29 and path[31:] == ["de"] * 19
    assert language_id.identify(df.limit(0)).count() == 0


def plain_path(scores):
    v, back = scores[0].copy(), []
    for row in scores[1:]:
        step = v[None, :] - language_id.SWITCH * (1 - np.eye(len(v)))
        back.append(step.argmax(axis=1))
        v = step.max(axis=1) + row
    return v.max()


def value(scores, path):
    return scores[np.arange(len(path)), path].sum() - language_id.SWITCH * (np.diff(path) != 0).sum()


def test_paths_are_the_best():
    rng = np.random.default_rng(17)
    for n in (2, 3, 4, 5):
        labeller = language_id.Labeller(language_id.Model([str(i) for i in range(n)], None, None, None))
        for turn in range(200):
            size = int(rng.integers(1, 60))
            scores = -np.abs(rng.normal(0, rng.choice([0.5, 2]), (size, n)))
            for k in range(0, size, int(rng.integers(3, 21))):
                scores[k: k + 20, rng.integers(0, n)] += rng.choice([0.3, 1.5])
            assert abs(value(scores, labeller.path(scores)) - plain_path(scores)) < 1e-9


def test_short_stretches_between_others_count():
    labeller = language_id.Labeller(language_id.Model(["a", "b", "c"], None, None, None))
    scores = np.full((31, 3), -2.0)
    scores[:4] = -4
    scores[:4, 2], scores[4:14, 1], scores[14:, 0] = 0, 0, 0
    assert abs(value(scores, labeller.path(scores)) - plain_path(scores)) < 1e-9
    assert value(scores, labeller.path(scores)) == -24


def test_words_of_texts():
    w = language_id.words_of(["Ab c1d", None, "", "é-x́"])
    assert w.text.tolist() == [0, 0, 0, 3, 3] and w.letters.tolist() == [2, 1, 1, 1, 1]
