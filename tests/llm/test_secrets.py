"""Base spans against the plain patterns; the network by held-out accuracy and by its gradients."""

import hashlib
import random
import re

import numpy as np
import pytest

from acctpulse.llm import secrets as X
from acctpulse.llm import spans

SCHEMA = "doc_id bigint, text string, base string, label int, n_chars bigint"


def brute(text):
    text = text or ""
    assign = r"(%s)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)" % "|".join(
        "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")
    )
    found = [("assign", *m.span()) for m in re.finditer(assign, text) if len(m[2]) >= 6]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return found + [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]


def test_base_spans_follow_the_patterns():
    rng = random.Random(6)
    bits = ["token", "TOKEN", "ſecret", "api_key", "ApiKey", "passwd", " ", "=", ":", '"', "'", "abcdef", "12345", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "é", "-", "K"]
    for _ in range(5000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(14)))
        assert sorted(X.base_spans(text)) == sorted(brute(text)), repr(text)


def made(rng, n, texts):
    """Findings of invented documents: keys of several shapes among words, ids and addresses."""
    out = []
    for _ in range(n):
        words = [rng.choice(texts) for _ in range(60)]
        key = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        words[rng.randrange(60)] = rng.choice([f'token = "{key}"', key, "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))])
        words[rng.randrange(60)] = rng.choice(["4111111111111111", "2024-01-31T10:20:30Z", "https://example.com/some/page", "naive.name@example.com"])
        out.append(" ".join(words))
    return out


def test_network_separates_held_out_findings():
    rng = random.Random(1)
    words = ["thing", "inonethandstintion", "of", "erentionhereadthat", "nation", "veröffentlichung"]
    texts = made(rng, 400, words)
    got = [
        (X.encoded(*form, context=i % 2 == 0), y)
        for i, t in enumerate(texts) for a, b, y in X.findings(t) for form in ((t, a, b), X.variant(t, a, b, y, i))
    ]
    rows, labels = np.stack([r for r, _ in got]), np.array([y for _, y in got])
    net = X.train(rows[:1500], labels[:1500], epochs=6)
    found = net.scores(rows[1500:4000]) >= net.threshold
    assert found[labels[1500:4000] == 1].mean() >= 0.9 and found[labels[1500:4000] == 0].mean() <= 0.01
    again = X.train(rows[:1500], labels[:1500], epochs=6)
    assert np.array_equal(again.conv, net.conv) and again.threshold == net.threshold


def test_a_key_at_the_end_of_a_long_candidate_is_read():
    rng = random.Random(4)
    texts = made(rng, 300, ["thing", "inonethandstintion", "of", "erentionhereadthat", "nation"])
    got = [
        (X.encoded(*form, context=i % 2 == 0), y)
        for i, t in enumerate(texts) for a, b, y in X.findings(t) for form in ((t, a, b), X.variant(t, a, b, y, i))
    ]
    net = X.train(np.stack([r for r, _ in got])[:2500], np.array([y for _, y in got])[:2500], epochs=6)
    find, found = X.finder(net), 0
    for _ in range(40):
        path = "hooks/services/some-long-project-name/with-plain-words/and-more-of-them/"
        text = "see " + path + "".join(rng.choice("0123456789ABCDEFabcdef") for _ in range(40)) + " for it"
        found += find(text)[1] == [("learned", 4, len(text) - 7)]
    assert found >= 36
    assert find("see hooks/services/some-long-project-name/with-plain-words/and-more-of-them/page-2 for it")[1] == []
    assert X.windows(3, 40) == [(3, 40)] and X.windows(0, 100) == [(0, 48), (16, 64), (32, 80), (48, 96), (52, 100)]


def test_threshold_keeps_the_recall_and_lots_are_not_split(monkeypatch):
    rng = np.random.default_rng(5)
    # Half of the secrets look exactly like the others, so many score under one half.
    labels, lots = np.repeat([1, 0], 400), np.tile(np.arange(400), 2) // 2 + np.repeat([0, 1000], 400)
    rows = rng.integers(2, 12, (800, 2 * X.CONTEXT + X.BODY)).astype(np.int16)
    rows[:200] += 40
    asked = []
    real = X.Network.scores
    monkeypatch.setattr(X.Network, "scores", lambda net, r: (asked.append(r), real(net, r))[1])
    net = X.train(rows, labels, epochs=4, lots=lots)
    held = {r.tobytes() for r in asked[-1]}
    assert (real(net, asked[-1]) >= net.threshold).mean() >= X.RECALL and net.threshold < 0.5
    assert all((rows[i].tobytes() in held) == (rows[i + 1].tobytes() in held) for i in range(0, 400, 2)) and len(held) == 100


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(2)
    net = X.Network.fresh(1)
    rows = rng.integers(0, 30, (5, 2 * X.CONTEXT + X.BODY)).astype(np.int16)
    wanted, weight = np.array([1, 0, 1, 0, 1]), np.ones(5)
    net.conv, net.out = net.conv.astype(np.float64), net.out.astype(np.float64)

    def loss():
        p = 1 / (1 + np.exp(-net.forward(rows)[0]))
        return -np.mean(wanted * np.log(p) + (1 - wanted) * np.log(1 - p))

    grads = net.step(rows, wanted, weight)
    for name, at in (("conv", (1, 2, int(rows[0, 30]), 3)), ("conv", (0, 0, int(rows[1, 4]), 5)), ("out", (4,)), ("out", (20,))):
        value = getattr(net, name)
        here = value[at]
        value[at] = here + 1e-5
        up = loss()
        value[at] = here - 1e-5
        assert grads[name][at] == pytest.approx((up - loss()) / 2e-5, abs=1e-5)
        value[at] = here


def test_redaction():
    assert spans.redacted("a key b", [("hex", 2, 5)]) == "a [HEX] b"
    assert spans.redacted("token=abcdef rest", [("assign", 0, 12), ("hex", 6, 12)]) == "[ASSIGN] rest"
    assert spans.redacted("abcdef", [("x", 0, 3), ("y", 2, 5), ("z", 5, 6)]) == "[X][Z]"
    assert spans.redacted("plain", []) == "plain"


def test_table_digests_and_added_spans(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    docs = [(r.doc_id, r.text) for r in rows]
    rng = random.Random(3)
    hidden = {8_000_000 + i: "".join(rng.choice("0123456789abcdefABCDEF") for _ in range(36)) for i in range(20)}
    docs += [(i, f"some words before {k} and after them") for i, k in hidden.items()]
    docs += [(8_100_000 + i, t) for i, t in enumerate(made(rng, 60, ["plain", "words"]))]
    docs += [(None, None), (9_000_000, ""), (9_000_001, "hello token: abcdefgh"), (9_000_001, "hello token: abcdefgh")]
    df = spark.createDataFrame([(*d, "x", 1, 5) for d in docs], SCHEMA).repartition(3)
    got = X.digest(X.find_secrets(df)).collect()
    order = {k: i for i, k in enumerate(X.KINDS)}
    want = []
    for d, text in docs:
        base = sorted(brute(text), key=lambda s: (s[1], order[s[0]]))
        shown = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        want.append((d, *(sum(k == kind for k, *_ in base) for kind in X.KINDS[:3]), hashlib.sha256(shown.encode()).hexdigest()))
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    learned = {r.doc_id for r in got if "learned" in r.spans}
    assert len(learned & set(hidden)) >= 16
    assert len(learned - set(hidden)) <= 3
    clean = {r.doc_id: r for r in X.redact(df).collect()}
    assert clean[9_000_001].text == "hello [ASSIGN]" and clean[9_000_001].n_chars == 14 and clean[9_000_000].text == ""
    assert X.find_secrets(df.limit(0)).count() == 0 and X.redact(df.limit(0)).count() == 0


def test_few_labelled_secrets_still_give_a_network(spark):
    rng = random.Random(9)
    key = lambda: "".join(rng.choice("0123456789abcdefABCDEF") for _ in range(36))
    docs = [(i, f"some ordinary words of the document-of-number-{i} stand here before extraordinarily long{i} others") for i in range(400)]
    docs += [(1000 + i, f"some words before {key()} and after them") for i in range(10)] + [(2000, f"token = {key()}")]
    df = spark.createDataFrame([(*d, "x", 1, 5) for d in docs], SCHEMA).repartition(5)
    rows, labels, _ = X.labelled_findings(df)
    assert 0 < labels.sum() < X.PRIOR_FINDINGS
    learned = {r.doc_id for r in X.find_secrets(df).collect() if r.added}
    assert len(learned & set(range(1000, 1010))) >= 8 and len(learned) <= 13


def test_findings_are_the_smallest_hashes_of_all_documents(spark):
    docs = [(i, f"token: abcdefgh{i:08d} and extraordinarily{i}") for i in range(300)]
    one, more = (X.labelled_findings(spark.createDataFrame([(*d, "x", 1, 5) for d in docs], SCHEMA).repartition(n), most=40) for n in (1, 7))
    assert all(np.array_equal(a, b) for a, b in zip(one, more)) and one[1].sum() == 40
