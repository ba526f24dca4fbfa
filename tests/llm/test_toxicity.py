import random
import zlib

import numpy as np
import pyarrow as pa

from matchloom.llm import filters, toxicity, wordhash

CLEAN = "the river ran past old mills and green fields where people met to talk of rain and bread".split()
INSULTS = ["idiot", "moron", "scum", "worthless"]


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        words = [rng.choice(CLEAN) for _ in range(rng.randint(10, 60))]
        toxic = k % 4 == 0
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(INSULTS).upper() + "!"
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic), k % 2, "x"))
    return rows, labels


def labelled(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, toxic int, quality int, text string")


def test_held_out_accuracy(spark, table):
    rows, labels = corpus()
    got = {r.doc_id: r for r in toxicity.score_documents(table(rows), labelled(spark, labels)).collect()}
    truth = {i: t for i, t, _, _ in labels}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in truth)
    held = [i for i in truth if got[i].held_out]
    assert len(held) > 80 and np.mean([got[i].predicted == truth[i] for i in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())


def test_pairs_are_learned():
    """Either of two terms alone is harmless, both together are toxic: a case for the pair weights."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2, (2000, 2))
    y = (x[:, 0] & x[:, 1]).astype(np.float32)
    doc, k = np.nonzero(x)
    keys = np.array([5, 1 << 63], dtype=np.uint64)
    m = toxicity.train_machine(keys, doc, k, y)
    z = m.bias + x @ m.weights + 0.5 * ((x @ m.factors) ** 2 - (x**2) @ (m.factors**2)).sum(axis=1)
    assert ((z > 0) == (y > 0)).all() and abs(m.factors[0] @ m.factors[1]) > 0.5


def test_all_significant_terms_have_weights(spark, table):
    """Many rare insults, each in a few texts: no number of terms is too large."""
    rng = random.Random(4)
    insults = [f"{a}{b}{c}" for a in "bdfgkl" for b in "aeiou" for c in ("ggr", "zzk", "xxp", "vvt", "qqs", "jjm", "hhw")]
    rows = [(k, " ".join([*(rng.choice(CLEAN) for _ in range(20)), insults[k // 2 % len(insults)] if k % 2 else ""])) for k in range(8400)]
    machine = toxicity.fit(table(rows), labelled(spark, [(k, k % 2, 0, "x") for k, _ in rows]))
    assert len(machine.keys) >= len(insults)
    ((_, data, offsets),) = wordhash.text_slices(pa.array([f"people met {x} there" for x in insults] + ["people met there"]))
    assert (machine.scores(data, offsets) >= 0.5).tolist() == [True] * len(insults) + [False]


def test_slow_scorer(spark, table):
    """The score of each text by the formula, pair by pair."""
    rows, labels = corpus(300)
    machine = toxicity.fit(table(rows), labelled(spark, labels))
    got = {r.doc_id: r.score for r in toxicity.score_documents(table(rows), labelled(spark, labels)).collect()}
    for i, t in rows[:60]:
        ((_, data, offsets),) = wordhash.text_slices(pa.array([t]))
        present = sorted(set(toxicity.terms(data, offsets)[1].tolist()) & set(machine.keys.tolist()))
        at = [int(np.searchsorted(machine.keys, np.uint64(h))) for h in present]
        z = machine.bias + sum(machine.weights[a] for a in at) + sum(machine.factors[a] @ machine.factors[b] for n, a in enumerate(at) for b in at[:n])
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-9


def test_repeated_rows_are_one_document_to_the_fit(spark, table, monkeypatch):
    """The table four times, and one labelled document a thousand times: the same machine and scores, and no more lists on the driver than documents."""
    rows, labels = corpus(400)
    label_table = labelled(spark, labels)
    machine = toxicity.fit(table(rows), label_table)
    trained = []
    real = toxicity.train_machine
    monkeypatch.setattr(toxicity, "train_machine", lambda keys, doc, k, y: (trained.append(len(y)), real(keys, doc, k, y))[1])
    hot = next((i, t) for i, t in rows if i % 4 == 0 and zlib.crc32(str(i).encode()) % 5)
    again = toxicity.fit(table(rows * 4 + [hot] * 1000), label_table)
    assert trained == [sum(zlib.crc32(str(i).encode()) % 5 != 0 for i, _ in rows)]
    assert (again.keys == machine.keys).all() and again.bias == machine.bias
    assert (again.weights == machine.weights).all() and (again.factors == machine.factors).all()
    # Rows of one doc_id with different texts count by the text of least digest, whatever their order.
    other = [(i, t + " mills") for i, t in rows[:50]]
    assert (toxicity.fit(table(rows + other), label_table).weights == toxicity.fit(table(other[::-1] + rows), label_table).weights).all()


def test_labels_of_held_out_rows_change_nothing(spark, table):
    rows, labels = corpus(200)
    one = sorted(map(tuple, toxicity.score_documents(table(rows), labelled(spark, labels)).collect()))
    flipped = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t, q, x) for i, t, q, x in labels]
    assert sorted(map(tuple, toxicity.score_documents(table(rows), labelled(spark, flipped)).collect())) == one


def test_odd_rows_and_labels(spark, table, odd):
    rows, labels = corpus(200)
    mixed = [*labels, (None, 1, 0, "x"), (99999, 1, 0, "x"), (3, None, 0, "x"), (4, 0, 0, "x"), (4, 1, 0, "x")]
    shifted = [(i + 5000, t) for i, t in rows]
    more = [((None if i is None else i + 5000 if i > 99 else i), t, q, x) for i, t, q, x in mixed]
    got = toxicity.score_documents(table(odd + shifted), labelled(spark, more + [(i + 5000, t, q, x) for i, t, q, x in labels])).collect()
    assert len(got) == len(odd) + 200 and all(0 <= r.score <= 1 for r in got)
    empties = {round(r.score, 12) for r in got if r.doc_id in (1, 2, 3)}
    assert len(empties) == 1 and empties.pop() < 0.5
    assert all(not r.held_out for r in got if r.doc_id is None)


def test_without_labels_nothing_is_toxic(spark, table, odd):
    for labels in ([], [(4, 0, 0, "x"), (7, 0, 0, "x")], [(4, 1, 0, "x")]):
        got = toxicity.score_documents(table(odd), labelled(spark, labels)).collect()
        assert len(got) == len(odd) and {r.score for r in got} == {0.0}
    assert toxicity.score_documents(table([]), labelled(spark, [])).collect() == []


def test_filter_keeps_columns(spark, table):
    rows, labels = corpus(400)
    docs = table(rows)
    kept = filters.without_toxic(docs, labelled(spark, labels))
    assert kept.columns == docs.columns
    gone = {i for i, _ in rows} - {r.doc_id for r in kept.collect()}
    truth = {i for i, t, _, _ in labels if t}
    assert len(gone & truth) > 0.95 * len(truth) and len(gone - truth) < 5


def test_words():
    texts = ["Ärger über 3.5 kg, Otto's 1,000!", "", "ÄRGER x", "ärger"]
    ((_, data, offsets),) = wordhash.text_slices(pa.array(texts))
    w = wordhash.words_of(data, offsets)
    assert np.bincount(w.doc, minlength=4).tolist() == [7, 0, 2, 1]
    assert w.hash[0] == w.hash[7] == w.hash[9] and len(set(w.hash.tolist())) == 8
    assert w.number.tolist()[:7] == [False, False, True, False, False, False, True]
    assert w.capital.tolist() == [True, False, False, False, True, False, False, True, False, False]
    assert w.opens.tolist()[:7] == [True] + [False] * 6
    small = [h for _, d, o in wordhash.text_slices(pa.array(texts), 8) for h in wordhash.words_of(d, o).hash.tolist()]
    assert small == w.hash.tolist()
