"""Base spans against the plain patterns; disguises mapped back to the source."""

import hashlib
import random
import re

import pytest

from acctpulse.llm import pii

SCHEMA = "doc_id bigint, text string, base string, added int, kind string"
RULES = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and checks(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def checks(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    return [(k, *m.span()) for k, (p, ok) in RULES.items() for m in re.finditer(p, text or "") if ok(m[0])]


def test_base_spans_follow_the_patterns():
    rng = random.Random(6)
    bits = ["a", "Z.", "@", "x@y.z", ".", "-", "+", "1", "12", "255", "256", "4111111111111111", " ", "(", "é", "0", "4111 1111-1111 1111", "１", "@@", "+1 (555) 010-9999"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(14)))
        assert pii.base_spans(text) == brute(text), repr(text)


@pytest.mark.parametrize(
    ("kind", "hidden"),
    [
        ("email", "jane.doe [at] example [dot] com"), ("email", "jane(at)example.com"), ("email", "jane at example dot com"),
        ("email", "jаne@exаmple.com"), ("email", "ｊａｎｅ＠ｅｘａｍｐｌｅ．ｃｏｍ"), ("email", "jane&#64;example&#46;com"), ("email", "jane @ example . org"),
        ("email", "jane dot doe at mail dot example dot com"), ("email", "ja​ne@exam​ple.com"), ("email", "juan {arroba} example {punto} es"),
        ("ip", "10 [dot] 0 [dot] 0 [dot] 7"), ("ip", "１０.0.0.7"), ("ip", "10 dot 20 dot 30 dot 40"),
        ("card", "four one one one one one one one one one one one one one one one"), ("card", "4111 1111 1111 1111"), ("card", "4111–1111–1111–1111"),
        ("phone", "plus one five five five zero one zero nine nine nine nine"), ("phone", "+１ (555) 010-９９９９"),
        ("card", "vier eins eins eins eins eins eins eins eins eins eins eins eins eins eins eins"),
    ],
)
def test_disguises_are_found_where_they_stand(kind, hidden):
    for before, after in (("", ""), ("Contact: ", " today."), ("é 日本 ", "\nEnd"), ("(", ")")):
        text = before + hidden + after
        _, added = pii.personal_spans(text)
        base = pii.base_spans(text)
        assert [(kind, len(before), len(before) + len(hidden))] == added, (text, added, base)


@pytest.mark.parametrize(
    "text",
    [
        "We met at the dot com office.", "Look at example.com for more.", "one two three and so on", "Er sah acht neun zehn Leute.", "see [1] at [2]",
        "Punkt 3 at 4 dot 5", "prices at 10 point 5 percent", "It is. At last. The dot is gone.", "Naïve café, e-mail me — at home.", "un deux trois",
        "version 1.2.3.4.5 or 300.1.1.1", "αβγ и Москва",
    ],
)
def test_clean_texts_gain_nothing(text):
    assert pii.personal_spans(text)[1] == []


@pytest.mark.parametrize(
    ("hidden", "base"),
    [("jаne@example.com", "ne@example.com"), ("jane [dot] doe@example.com", "doe@example.com"), ("john@mail.exаmple.com", "john@mail.ex")],
)
def test_a_disguise_of_a_part_is_found_beside_the_base_span(hidden, base):
    text = f"Contact: {hidden} today."
    got = pii.personal_spans(text)
    assert [text[a:b] for _, a, b in got[0]] == [base] and [text[a:b] for _, a, b in got[1]] == [hidden]
    assert got[0] == brute(text)


@pytest.mark.parametrize(
    "hidden",
    ["jane.doe at example.com", "jane at example dot kr", "jane at example dot co dot nz", "jane @ example . ie", "jane at example dot photography", "jane_d at mail.example.cz"],
)
def test_other_spelled_addresses(hidden):
    text = f"Ask {hidden} today."
    assert [text[a:b] for _, a, b in pii.personal_spans(text)[1]] == [hidden]
    text = "Please write to jane at example.com today."
    assert [text[a:b] for _, a, b in pii.personal_spans(text)[1]] == ["jane at example.com"]


@pytest.mark.parametrize("text", ["at some point soon", "arrive at any point in time", "contact us at example.com", "see more at example.com", "Meet @ noon. My friend"])
def test_plain_uses_of_the_words_gain_nothing(text):
    assert pii.personal_spans("They " + text)[1] == []


def test_base_spans_stay_beside_added_ones():
    text = "a@b.example and jane [at] example [dot] com and 10.0.0.1"
    base, added = pii.personal_spans(text)
    assert base == brute(text) and len(base) == 2 and len(added) == 1


def test_long_runs_stay_linear():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1 " * 100_000, "a.b " * 80_000, "@ " * 100_000, "a at b dot " * 30_000, "one " * 60_000):
        pii.personal_spans(text)


def test_table_and_digests(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    docs += [(None, None), (7_000_000, ""), (7_000_001, "x 10.0.0.1"), (7_000_001, "x 10.0.0.1")]
    df = spark.createDataFrame([(*d, "x", 1, "y") for d in docs], SCHEMA).repartition(3)
    got = pii.digest(pii.find_personal(df)).collect()
    want = []
    for d, text in docs:
        shown = ",".join(f"{k}:{a}:{b}" for k, a, b in brute(text))
        counts = [sum(k == kind for k, *_ in brute(text)) for kind in pii.KINDS]
        want.append((d, *counts, hashlib.sha256(shown.encode()).hexdigest(), shown))
    assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)
    assert pii.find_personal(df.limit(0)).count() == 0


def test_set_apart_and_mixed_spellings():
    samples = {
        "write to j a n e @ e x a m p l e . c o m now": ("email", "j a n e @ e x a m p l e . c o m"),
        "host 1 9 2 dot 1 6 8 dot 1 dot 1 is up": ("ip", "1 9 2 dot 1 6 8 dot 1 dot 1"),
        "call plus four four two oh seven nine four six oh nine five eight": ("phone", "plus four four two oh seven nine four six oh nine five eight"),
    }
    for text, (kind, said) in samples.items():
        _, added = pii.personal_spans(text)
        assert [(k, text[a:b]) for k, a, b in added] == [(kind, said)], text
    for text in ("a b @ c", "I a m @ home", "oh one day", "1 2 3 dot"):
        assert pii.personal_spans(text) == ([], [])


class ListTape:
    """The rewriting with a source span per character, as lists."""

    def __init__(self, text):
        self.text, self.at, self.new = text, [(i, i + 1) for i in range(len(text))], [False] * len(text)

    def rewrite(self, changes):
        text, at, new, last = "", [], [], 0
        for a, b, put in [*changes, (len(self.text), len(self.text), "")]:
            text += self.text[last:a] + put
            at += self.at[last:a] + [(self.at[a][0], self.at[b - 1][1])] * len(put) if put else self.at[last:a]
            new += self.new[last:a] + [True] * len(put)
            if not put and b > a and new:
                new[-1] = True
            last = b
        self.text, self.at, self.new = text, at, new

    def source(self, start, end):
        return self.at[start][0], self.at[end - 1][1], any(self.new[start:end])


def test_spans_map_back_as_with_lists():
    rng = random.Random(11)
    for _ in range(3000):
        text = "".join(rng.choice("abcde") for _ in range(rng.randrange(1, 14)))
        one, two = pii.Tape(text), ListTape(text)
        for _ in range(rng.randrange(1, 4)):
            cuts = sorted(rng.sample(range(len(one.text) + 1), min(len(one.text) + 1, 2 * rng.randrange(0, 4))))
            changes = [(a, b, rng.choice(["", "x", "yz", "uvw"])) for a, b in zip(cuts[::2], cuts[1::2])]
            one.rewrite(changes)
            two.rewrite(changes)
        assert one.text == two.text
        for start in range(len(one.text)):
            for end in range(start + 1, len(one.text) + 1):
                assert one.source(start, end) == two.source(start, end), (text, one.steps, start, end)


def test_memory_follows_the_changes():
    import tracemalloc

    text = "plain words and more of them " * 70_000 + "j\u0430ne@ex\u0430mple.com " + "tail " * 1000
    tracemalloc.start()
    base, added = pii.personal_spans(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [text[a:b] for _, a, b in added] == ["j\u0430ne@ex\u0430mple.com"]
    # The words of the text are what is large; the map is not.
    assert pii.normalised(text).steps[0].nbytes < 1000 and peak < 80 * len(text)
