import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from seqsieve.llm import gru, lm


def small_model(seed=0):
    rng = np.random.default_rng(seed)
    model = gru.GatedModel(4, 5, seed)
    for k in model.p:
        model.p[k] = rng.standard_normal(model.p[k].shape).astype(np.float64) * 0.5
    model.freeze()
    return model


def plain_score(model, doc):
    """One document step by step."""
    p, n, h, before, total = model.p, gru.HIDDEN, np.zeros(gru.HIDDEN), 0, 0.0
    for token in doc:
        gates = p["embed"][before] @ p["input"] + p["bias"]
        inner = h @ p["state"]
        z, r = (1 / (1 + np.exp(-(gates[i * n : (i + 1) * n] + inner[i * n : (i + 1) * n]))) for i in (0, 1))
        h = (1 - z) * np.tanh(gates[2 * n :] + r * inner[2 * n :]) + z * h
        c, w = divmod(int(token), model.size)
        for scores, k in ((h @ p["class"] + p["class_bias"], c), (p["word"][c] @ h + p["word_bias"][c], w)):
            total += scores[k] - np.log(np.exp(scores).sum())
        before = int(token)
    return total / math.log(10)


def docs_of(seed, lengths):
    rng = np.random.default_rng(seed)
    return [np.append(rng.integers(1, 20, n), 0) for n in lengths]


def test_scores_of_whole_documents(monkeypatch):
    model, docs = small_model(), docs_of(1, [0, 3, 200, 17, 1, 64, 65, 5])
    want = [plain_score(model, d) for d in docs]
    for window, lanes in ((64, 256), (3, 2), (7, 1)):
        monkeypatch.setattr(gru, "SCORED_WINDOW", window)
        monkeypatch.setattr(gru, "SCORED_LANES", lanes)
        assert np.allclose(model.score(docs), want, rtol=1e-4)
    assert len(model.score([])) == 0


def test_the_softmax_is_a_distribution():
    model = small_model(2)
    hidden = np.tile(np.random.default_rng(3).standard_normal(gru.HIDDEN), (20, 1))
    found, _ = model._log_probabilities(hidden, np.arange(20))
    assert np.exp(found).sum() == pytest.approx(1)


def test_gradients_by_differences():
    model, docs = small_model(4), docs_of(5, [6, 3])
    ids, owner = gru._lay_out(docs, 2)
    before, starts = gru._shifted(ids, owner)
    start = np.zeros((ids.shape[1], gru.HIDDEN))

    def loss():
        model.freeze()
        hidden = model._steps(before, starts, start, None).astype(float)
        live = ids >= 0
        return -model._log_probabilities(hidden[live], ids[live])[0].mean()

    grads, _ = model._window(ids, before, starts, start)
    rng = np.random.default_rng(6)
    for name, value in model.p.items():
        flat, grad = value.reshape(-1), grads[name].reshape(-1)
        for i in rng.choice(len(flat), 4, replace=False):
            old = flat[i]
            flat[i] = old + 3e-3
            up = loss()
            flat[i] = old - 3e-3
            down = loss()
            flat[i] = old
            assert grad[i] == pytest.approx((up - down) / 6e-3, abs=2e-4), name


def test_training_lowers_the_loss():
    model = gru.GatedModel(4, 5)
    docs = [np.array([1, 2, 3, 4] * 10 + [0]) for _ in range(40)]
    model.set_frequencies(np.bincount(np.concatenate(docs), minlength=20))
    model.freeze()
    before = model.score(docs).sum()
    model.train(docs, passes=20)
    assert model.score(docs).sum() > 0.6 * before


def test_a_text_s_probabilities_add_up():
    """Over all words seen and one unseen, after any text, the model's shares sum to 1."""
    counts = Counter({f"w{i}".encode(): 3000 - i for i in range(2600)})
    groups = {}
    for word, n in counts.items():
        mass = groups.setdefault(lm._group(word), [0, 0])
        mass[0] += n
        mass[1] += 1
    words, n = zip(*counts.most_common())
    scorer = lm.Scorer(list(words), list(n), sum(n) + 10, len(n) + 1, 10, groups)
    total = 0.0
    for word in words:
        ids, _, share, _, _ = scorer.encode([word])
        scorer.model.freeze()
        total += 10 ** (share + _first(scorer.model, ids[0]))
    for g in range(lm.GROUPS):
        total += 10 ** (math.log10(0.1) - scorer.group_log[g] + _first(scorer.model, scorer.group_ids[g]))
    total += 10 ** _first(scorer.model, 0)
    assert total == pytest.approx(1, abs=1e-3)


def _first(model, token):
    return float(model.score([np.array([token])])[0])


def test_base_scores_and_edges(table, words):
    rows = [(i, words(i, 5 + i % 40, 300), "en", "s") for i in range(150)]
    rows += [(None, "W1 w2 unseen-by-any", "en", "s"), (200, None, "en", "s"), (201, "", None, None), (3, words(3, 8), "en", "s"), (3, words(3, 8), "en", "s"), (204, words(9, 30_000), "en", "s")]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    counts = Counter()
    for doc_id, text, *_ in rows:
        if not held(doc_id):
            counts.update([*lm.words_of((text or "").encode()), None])
    total, kinds = sum(counts.values()), len(counts)
    want = []
    for doc_id, text, *_ in rows:
        tokens = [*lm.words_of((text or "").encode()), None]
        base = sum(math.log10((counts[t] + 0.1) / (total + 0.1 * (kinds + 1))) for t in tokens)
        want.append((doc_id, held(doc_id), len(tokens), sum(counts[t] > 0 for t in tokens), total, round(base, 6)))
    got = lm.score_corpus(table(rows, clashing=True)).collect()
    assert sorted([(*r[:5], round(r.base_score, 6)) for r in got], key=repr) == sorted(want, key=repr)
    assert all(r.score < 0 for r in got)
    assert lm.score_corpus(table([])).collect() == []
    alone = next(i for i in range(1000) if held(i))
    untaught = lm.score_corpus(table([(alone, "a b", "en", "s")])).collect()
    assert [(r.n_known, r.train_tokens) for r in untaught] == [(0, 0)] and untaught[0].base_score == 0


def test_rare_words_join_their_counts(table, words, monkeypatch):
    """The same scores whether counts travel with the scorer or by the join."""
    rows = [(i, words(i, 40, 500), "en", "s") for i in range(60)]
    docs = table(rows)
    whole = {r.doc_id: r for r in lm.score_corpus(docs).collect()}
    monkeypatch.setattr(lm, "KNOWN", 100)
    for r in lm.score_corpus(docs).collect():
        assert r.n_known == whole[r.doc_id].n_known
        assert r.base_score == pytest.approx(whole[r.doc_id].base_score)


def test_all_training_documents_teach_the_recurrent_weights(table, words, monkeypatch):
    """Also the ends of long ones, in any partitions, with the means taken in groups."""
    monkeypatch.setattr(lm, "SHARD_TOKENS", 600)
    monkeypatch.setattr(lm, "SHARD_LANES", 8)
    monkeypatch.setattr(lm, "PIECE", 500)
    monkeypatch.setattr(lm, "FAN_IN", 2)
    rows = [(i, words(i, 40, 50), "en", "s") for i in range(60)] + [(60, words(60, 3_000, 50) + " a b" * 4_000, "en", "s")]
    docs = table(rows)

    def learned(docs):
        scorer, _ = lm.count(docs)
        text = [scorer.encode(lm.words_of(b"a b " * 50))[0]]
        before = scorer.model.score(text)[0]
        lm.train(lm.encode(docs, scorer), scorer.model)
        return scorer, before, scorer.model.score(text)[0]

    scorer, before, after = learned(docs)
    assert after > 0.9 * before
    again, _, _ = learned(docs.repartition(7))
    assert all(np.array_equal(again.model.p[k], v) for k, v in scorer.model.p.items())


def test_scores_equal_a_scalar_replay(table, words):
    """The model's share of a score, word by word with plain loops, for short documents."""
    rows = [(i, words(i, 12, 40), "en", "s") for i in range(40)] + [(41, "", "en", "s"), (42, None, "en", "s")]
    docs = table(rows)
    scorer, counts = lm.count(docs)
    encoded = lm.encode(docs, scorer)
    lm.train(encoded, scorer.model)
    got = {r.doc_id: r.score for r in lm.score(encoded, scorer, counts).collect()}
    for i, text, *_ in rows:
        ids, _, share, _, others = scorer.encode(lm.words_of((text or "").encode()))
        assert not others and got[i] == pytest.approx(share + plain_score(scorer.model, ids), rel=1e-4)


def test_a_long_piece_leaves_no_lanes_idle():
    rng = np.random.default_rng(5)
    lengths, left = [lm.PIECE], lm.SHARD_TOKENS - lm.PIECE
    while left > 0:
        lengths.append(min(left, int(rng.integers(1, 1200))))
        left -= lengths[-1]
    ids, _ = gru._lay_out([np.zeros(n, np.int64) for n in lengths], lm.SHARD_LANES)
    assert (ids >= 0).mean() > 0.9


@pytest.mark.parametrize("kind", [pa.binary(), pa.large_binary()])
def test_texts_are_cut_into_words_without_objects_for_each(monkeypatch, kind):
    """Whatever the bytes, the nulls, the slice and the size of a part."""
    texts = [None, b"", b" \t\n", b"a  B\xff\xc3 \x0bA a", *(bytes([97, i, 66, i, i]) for i in range(256)), b"long word " * 500, b"end"]
    for size in (1, 40, 10**6):
        monkeypatch.setattr(lm, "CUT", size)
        got = []
        for rows, lengths, places, distinct in lm._cut(pa.array([b"before", *texts], kind).slice(1)):
            words = [distinct[i].as_py() for i in places]
            assert rows.stop - rows.start == len(lengths) and len(words) == lengths.sum()
            for n in lengths:
                got.append(words[:n])
                words = words[n:]
        assert got == [lm.words_of(t) for t in texts]
    assert list(lm._cut(pa.array([], kind))) == []


def test_large_weights_do_not_overflow():
    model, docs = small_model(7), docs_of(8, [30, 9])
    assert model.bounded
    model.p["word_bias"][0] += 2_000
    model.p["class_bias"] -= 2_000
    model.freeze()
    assert not model.bounded
    plain = small_model(7)  # a softmax takes no notice of what all its scores have in common
    assert np.allclose(model.score(docs), [plain_score(plain, d) for d in docs], rtol=1e-4)


def test_lanes_that_have_ended_have_no_gradients():
    model, docs = small_model(9), docs_of(10, [12, 2, 5])
    ids, owner = gru._lay_out(docs, 3)
    before, starts = gru._shifted(ids, owner)
    grads, _ = model._window(ids, before, starts, np.zeros((3, gru.HIDDEN)))
    summed = {}
    for doc in docs:
        ids, owner = gru._lay_out([doc], 1)
        own, _ = model._window(ids, *gru._shifted(ids, owner), np.zeros((1, gru.HIDDEN)))
        for k, g in own.items():
            summed[k] = summed.get(k, 0) + g * len(doc)
    total = sum(map(len, docs))
    assert all(np.allclose(g, summed[k] / total, atol=1e-5) for k, g in grads.items())
