import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import mixing
from tidemill.llm.mixing import fold_of, huffman, score_texts
from tidemill.llm.toxicity import Model, features, fit, fold, matches, toxicity

INSULTS = ["grobnik", "slimeface", "vilewart"]


def corpus(n=1600, seed=1):
    rng = random.Random(seed)
    clean = [f"plain{k}" for k in range(300)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(clean) for _ in range(rng.randrange(5, 120))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(1 + len(words) // 15):
                words[rng.randrange(len(words))] = rng.choice(INSULTS[:2] + ["zurk" + rng.choice("abcdefgh")])
        elif i % 4 == 1:
            words.insert(0, "famous grobnik museum")
        rows.append((i, " ".join(words), "kept"))
        labels.append((i, int(toxic)))
    return rows, labels


def test_folding():
    assert fold("Gr0bnik GRΟBNIK gr​obnik $limef@ce") == ["grobnik", "grobnik", "grobnik", "slimeface"]
    assert fold(None) == [] and fold("...") == []
    assert fold("ｇｒｏｂｎｉｋ") == ["grobnik"]


def test_folding_parts_words_at_unicode_signs():
    text = "“grobnik” ‘grobnik’ «grobnik» grobnik—grobnik grobnik–grobnik grobnik… ¿grobnik? ¡grobnik! 「grobnik」、grobnik。 „gr0bnik‟ 【grobnik】"
    assert fold(text) == ["grobnik"] * 14
    assert fold("naïve e\u0301te\u0301 हिन्दी 中文。") == ["naïve", "été", "हिन्दी", "中文"]
    machine = Model({" vile ": 3.0}).machine()
    assert features(machine, "so “vile” he said") == features(machine, "so vile he said") != (0.0, 0.0)


def test_matches_stems_words_and_exceptions():
    machine = Model({" grob": 2.0, " vile ": 3.0}, frozenset({" famous grobnik "})).machine()
    words = fold("a grobnik vile vilewart famous grobnik")
    assert sorted(max(x.values()) for x in matches(machine, words).values()) == [2.0, 3.0]
    assert features(machine, "") == (0.0, 0.0) == features(None, "x y")


def test_toxicity_learns_and_holds_out(spark):
    rows, labels = corpus()
    rows += [(9001, None, "kept"), (9002, "", "kept"), (9003, "GR0BNIK " * 3000, "kept"), (0, rows[0][1], "kept"), (9004, "plain words only", "kept")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    table = spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity(docs, table)
    out = got.collect()
    assert got.columns == ["doc_id", "text", "held_out", "score", "predicted"] and len(out) == len(rows)
    truth = dict(labels)
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        if r.doc_id in truth:
            assert r.predicted == truth[r.doc_id], r
    by = {r.doc_id: r for r in out}
    assert by[9003].predicted == 1 and by[9001].score == by[9002].score == by[9004].score < 0.5
    model = fit(docs, table)
    assert " zurk" in model.entries and " famous grobnik " in model.exceptions


def test_toxicity_scores_against_plain_matching(spark):
    """Scores worked out from the model's lexicon by slicing strings, word by word, without an automaton."""
    rows, labels = corpus(700, 5)
    rows += [(8001, "famous grobnik museum and a grobnik, slimeface!", "kept"), (8002, None, "kept"), (8003, "“Gr0bnik” — sl1meface… zurkzz", "kept")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = fit(docs, table)
    assert model.entries and model.exceptions
    a, b, c = model.curve

    def plain(text):
        words = fold(text)
        told = {}
        for i, word in enumerate(words):
            for entry, weight in model.entries.items():
                stem = entry.strip(" ")
                if word == stem if entry.endswith(" ") else word.startswith(stem):
                    told.setdefault(i, []).append(weight)
        for i in range(len(words) - 1):
            if f" {words[i]} {words[i + 1]} " in model.exceptions:
                told.pop(i, None), told.pop(i + 1, None)
        x = math.log1p(100 * sum(max(w) for w in told.values()) / (len(words) + 20)) if told else 0.0
        return 1 / (1 + math.exp(-max(-35, min(35, a + b * x + c * bool(told)))))

    from tidemill.llm.toxicity import score

    for r in score(docs, model).collect():
        assert r.score == pytest.approx(plain(r.text), abs=1e-9) and r.predicted == (r.score >= 0.5)


def test_one_id_with_many_rows_counts_once(spark):
    rows, labels = corpus(400, 3)
    docs = spark.createDataFrame(rows + [rows[4]] * 500, "doc_id long, text string, score string")
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    alone = spark.createDataFrame(rows, "doc_id long, text string, score string")
    assert fit(docs, table).entries == fit(alone, table).entries


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.predicted for r in toxicity(docs, none).collect()] == [0, 0]
    assert toxicity(docs.filter("false"), none).count() == 0


def test_huffman_paths_are_a_prefix_code():
    rng = np.random.default_rng(0)
    counts = rng.integers(1, 1000, 200)
    starts, nodes, bits, logits = huffman(counts)
    codes = ["".join(map(str, bits[a:b])) for a, b in zip(starts[:-1], starts[1:])]
    assert abs(sum(2.0 ** -len(c) for c in codes) - 1) < 1e-12 and len(set(codes)) == 200
    p = counts / counts.sum()
    entropy = -(p * np.log2(p)).sum()
    assert entropy <= (p * [len(c) for c in codes]).sum() < entropy + 1
    cost = sum(p[i] * math.log2(1 + math.exp(-x if b else x)) for i in range(200) for x, b in zip(logits[nodes[starts[i] : starts[i + 1]]], bits[starts[i] : starts[i + 1]]))
    assert cost == pytest.approx(entropy, abs=1e-3)


@pytest.mark.parametrize("vocabulary", [8, 1 << 17])
def test_base_scores_against_brute_force(spark, docs, rows, vocabulary):
    got = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in score_texts(docs, vocabulary=vocabulary).collect())
    split = lambda t: [w for w in (t or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()] + [None]
    fold_number = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5
    counts = Counter(w for r in rows if fold_number(r[0]) != 1 for w in split(r[1]))
    total, distinct = sum(counts.values()), len(counts)
    expect = Counter()
    for r in rows:
        words = split(r[1])
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in words)
        expect[(r[0], fold_number(r[0]) == 1, len(words), sum(counts[w] > 0 for w in words), total, round(base, 6))] += 1
    assert got == expect


def test_decisions_spell_words_and_sum_to_one():
    """The byte code of a word can be read back from its decisions, and each decision's two sides sum to one."""
    model = mixing.Model(16, 10, 3, np.zeros(0, np.uint64), huffman(np.array([5])), np.zeros(2, bool))
    tokens = mixing.Tokens([b"Ab c", b"", "é".encode()])
    assert tokens.bounds.tolist() == [0, 3, 4, 6]
    places = np.flatnonzero(tokens.word_at >= 0)
    word, bit, *_ = mixing.byte_decisions(model, tokens, places)
    read = [np.packbits(bit[word == w]).tobytes() for w in range(len(places))]
    assert read == [b"ab ", b"c ", "é ".encode()]
    x = np.linspace(-9, 9, 50)
    gate = np.zeros(50, int)
    one, zero = mixing._cost(model, gate, x, np.ones(50, int)), mixing._cost(model, gate, x, np.zeros(50, int))
    assert np.allclose(2.0**-one + 2.0**-zero, 1)


def test_model_beats_the_base_on_held_out_texts(spark):
    rng = random.Random(7)
    common = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(60)]
    made = []
    for i in range(300):
        words, at = [], rng.randrange(60)
        for _ in range(150):
            at = (at * 7 + rng.choice((1, 1, 1, 5))) % 60
            words.append(common[at] if rng.random() < 0.9 else "".join(rng.choice("abcdefgh") for _ in range(6)))
        made.append((i, " ".join(words)))
    out = score_texts(spark.createDataFrame(made, "doc_id long, text string").repartition(4))
    held = out.filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert held["s"] > held["b"] * 0.75
    assert out.filter("held_out").count() == sum(zlib.crc32(str(i).encode()) % 5 == 1 for i in range(300))


def test_frequent_words_outside_the_tree_cost_less_than_their_spelling(spark):
    rng = np.random.default_rng(3)
    words = ["".join(map(chr, 97 + rng.integers(0, 26, 9))) for _ in range(4000)]
    made = [(i, " ".join(words[k] for k in rng.integers(0, 4000, 400))) for i in range(200)]
    docs = spark.createDataFrame(made, "doc_id long, text string").repartition(4)
    cost = score_texts(docs, vocabulary=100).filter("held_out").agg((F.sum("score") / F.sum("n_tokens")).alias("s")).first()["s"]
    assert -cost / math.log10(2) < 16  # 12 bits a word by count; spelled at random they have 9 * log2(26) = 42


def some_units(rng, units, docs=6):
    words = [f"w{k}" for k in range(30)]
    return [[" ".join(rng.choice(words) for _ in range(rng.randrange(25))).encode() for _ in range(docs)] for _ in range(units)]


@pytest.mark.parametrize("hot", [False, True])
def test_buckets_answer_with_all_counts(hot):
    """Counts of words, and best next word, its count and total of two-word contexts, against plain counting.

    hot: a context of over 200,000 occurrences, and a text that holds most of those of another.
    """
    rng = random.Random(4)
    units, buckets = some_units(rng, 5), 3
    if hot:
        for k in range(3):
            units[k] += [b"x y p " * 40_000 + b"x y q " * 30_000, b"a b c " * 200]
        units[4].append(b"a b c " * 2000)
    training = [True, True, False, True, True]
    counts, after = Counter(), {}
    split = lambda t: [*t.split(), b"<end>"]
    for texts, learns in zip(units, training):
        for t in texts if learns else ():
            before = (b"", b"")
            for w in split(t):
                counts[w] += 1
                after.setdefault(before, Counter())[w] += 1
                before = (before[1], w)
    asked = [mixing.ask(mixing.Tokens(t), learns, buckets) for t, learns in zip(units, training)]
    answered = {k: [] for k in range(len(units))}
    told = np.zeros(3, np.int64)
    for bucket in range(buckets):
        rows = [mixing.pa.RecordBatch.from_arrays([mixing.pa.array(np.full(r.num_rows, k)), *r.columns], names=["unit", *r.schema.names]) for k, a in enumerate(asked) if (r := a.filter(mixing.pc.equal(a.column(0), bucket))).num_rows]
        for r in mixing.answer(rows, 1000).to_pylist() if rows else ():
            if r["unit"] < 0:
                told += mixing.told_by_buckets([r["packed"]])[0]
            else:
                answered[r["unit"]].append(r)
    assert told.tolist() == [len(counts), sum(n == 1 for n in counts.values()), counts.total()]
    model = mixing.Model(16, counts.total(), len(counts), np.zeros(0, np.uint64), huffman(np.array([5])), np.zeros(2, bool))
    for k, texts in enumerate(units):
        _, _, best, total = mixing._unpacked([a["packed"] for a in answered[k]])
        here = {(a, b) for t in texts for a, b in zip([b"", b"", *split(t)], [b"", *split(t)][: len(split(t))])}
        left = [(c.most_common(1)[0][1], c.total()) for context, c in after.items() if context in here and (c.total() > 1 or not training[k])]
        assert sorted(x for x in zip(best.tolist(), total.tolist()) if x[1]) == sorted(left)
        (coding,) = mixing.code(model, mixing.Tokens(texts), training[k], answered[k], buckets, most=1 << 30)
        words = [w for t in texts for w in split(t)]
        assert coding.counts.tolist() == [counts[w] for w in words]
        flags, at = dict(zip(coding.flag_at.tolist(), coding.flag_bit.tolist())), 0
        for t in texts:
            mine, before = Counter(zip([b"", b"", *split(t)], [b"", *split(t)], split(t))), (b"", b"")
            own = Counter(split(t))
            for w in split(t):
                best = after.get(before, Counter()).most_common()
                best = [x for x in best if x[1] == best[0][1]]
                left = {x: n - (mine[(*before, x)] if training[k] else 0) for x, n in best}
                if len(best) == 1:  # which of equally frequent words is predicted is settled by hash
                    assert (at in flags) == (max(left.values()) > 0)
                    if at in flags:
                        assert flags[at] == (w == best[0][0])
                before, at = (before[1], w), at + 1
            del own


def test_bits_against_a_scalar_mixer(spark):
    """The whole model, decision by decision in plain Python, gives the same bits."""
    rng = random.Random(9)
    texts = [t.decode() for unit in some_units(rng, 8, 12) for t in unit]
    texts += [texts[3] + " newword another"] * 2 + ["long " + " ".join(rng.choice("abcdefg") for _ in range(500))]
    rows = spark.createDataFrame([(i, t, i % 3) for i, t in enumerate(texts)], "doc_id long, text string, role int").coalesce(2)
    rate, block = 0.02, 16
    model, units, buckets = mixing.train(rows, "bigint", vocabulary=20)
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    sides = Counter()

    def mixed_cost(weights, gate, x, bit):
        m = max(-mixing.LIMIT, min(mixing.LIMIT, sum(w * v for w, v in zip(weights, x))))
        near = round((m + mixing.LIMIT) * (mixing.FINE - 1) / (2 * mixing.LIMIT)) * 2 * mixing.LIMIT / (mixing.FINE - 1) - mixing.LIMIT
        place = (near + mixing.LIMIT) * (mixing.BINS - 1) / (2 * mixing.LIMIT)
        low = min(int(place), mixing.BINS - 2)
        table = model.refine[gate]
        final = 0.5 * near + 0.5 * (table[low] * (1 - place + low) + table[low + 1] * (place - low))
        return m, -math.log2(sigmoid(final) if bit else sigmoid(-final))

    for unit in units.collect():
        texts = mixing.unit_texts(unit.sizes, unit.text)
        tokens = mixing.Tokens(texts)
        answers = [a.asDict() for a in unit.answers]
        (coding,) = mixing.code(model, tokens, unit.role < 2, answers, buckets)
        got = mixing.bits_of(model, coding, unit.role, rate, block)
        some = list(mixing.code(model, tokens, unit.role < 2, answers, buckets, most=100))
        assert len(some) > 1 and np.allclose(np.concatenate([mixing.bits_of(model, c, unit.role, rate, block) for c in some]), got)
        tables = model.tables[unit.role]
        look = lambda table, slot: (tables[table][0][slot] / 16, int(tables[table][1][slot]))
        decisions = [(t, c, "flag") for c, t in enumerate(coding.flag_at.tolist())] + [(t, c, "tree") for c, t in enumerate(coding.token.tolist())]
        bits = np.zeros(len(texts))
        for doc in range(len(texts)):
            weights = {g: [float(w) for w in model.weights[g]] for g in range(mixing.GATES)}
            here = [d for d in decisions if tokens.doc[d[0]] == doc]
            first = int(tokens.bounds[doc])
            for b in sorted({(t - first) // block for t, *_ in here}):
                change = {g: [0.0] * 3 for g in weights}
                for t, c, kind in (d for d in here if (d[0] - first) // block == b):
                    if kind == "flag":
                        x = [float(coding.flag_logit[c]), *(look(0, s[c])[0] for s in coding.flag_slot)]
                        gate, bit = int(coding.flag_gate[c]), int(coding.flag_bit[c])
                    else:
                        (g, sure_g), (w, sure_w) = look(1, coding.slot[0][c]), look(2, coding.slot[1][c])
                        x, bit = [float(model.paths[3][coding.node[c]]), g, w], int(coding.bit[c])
                        gate = sure_w + 4 * (sure_g > 1)
                    m, cost = mixed_cost(weights[gate], gate, x, bit)
                    bits[doc] += cost
                    sides[kind] += 1
                    for k in range(3):
                        change[gate][k] += rate * (bit - sigmoid(m)) * x[k]
                for g in weights:
                    weights[g] = [w + c for w, c in zip(weights[g], change[g])]
        fresh = (model.once + 1) / (model.rest + 2) if model.rest else 1.0
        for t, seen in zip(coding.rare.tolist(), coding.seen.tolist()):
            if seen > 0:
                bits[tokens.doc[t]] -= math.log2((1 - fresh) * seen / max(1, model.rest))
                continue
            cost = 8.0
            if tokens.word_at[t] >= 0:
                _, bit, slots = mixing.byte_decisions(model, tokens, np.array([t]))
                cost = 0.0
                for k in range(len(bit)):
                    found = [look(3 + o, s[k]) for o, s in enumerate(slots)]
                    gate = 8 + found[2][1]
                    cost += mixed_cost(model.weights[gate], gate, [v for v, _ in found], int(bit[k]))[1]
                sides["spelled"] += 1
            bits[tokens.doc[t]] += cost - math.log2(fresh)
        assert np.allclose(got, bits, rtol=5e-4, atol=2e-2)
    assert min(sides[k] for k in ("flag", "tree", "spelled")) > 5


def test_copies_elsewhere_cost_less_and_equal_texts_the_same(spark):
    """A training text is judged by what others taught: with a copy in the corpus it is cheap, alone it is not."""
    rng = random.Random(2)
    fresh = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(80))
    twice = [fresh() for _ in range(20)]
    made = [(i, t) for i, t in enumerate(twice + twice + [fresh() for _ in range(40)])]
    out = score_texts(spark.createDataFrame(made, "doc_id long, text string").repartition(3), training=F.lit(True)).collect()
    by = {}
    for r in out:
        by.setdefault(made[r.doc_id][1], set()).add(round(r.score, 6))
    assert all(len(v) == 1 for v in by.values())
    score = {t: v.pop() for t, v in by.items()}
    assert max(-score[t] for t in twice) * 2 < min(-s for t, s in score.items() if t not in twice)


def test_empty_tables(spark, no_docs):
    assert score_texts(no_docs, vocabulary=50).count() == 0
    lone = spark.createDataFrame([(k, None) for k in range(40) if zlib.crc32(str(k).encode()) % 5 == 1][:1], "doc_id long, text string")
    (r,) = score_texts(lone, vocabulary=50).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (1, 0, 0) and r.base_score == 0.0


def test_fold_of(docs):
    for r in docs.select("doc_id", fold_of("doc_id").alias("f")).collect():
        assert r.f == zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5
