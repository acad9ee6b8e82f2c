"""Each stage of the pipeline against plain Python over its own input."""

import random
import re
from collections import Counter

import corpus_pipeline as P
import pytest
from test_packing_tokens import check_sequences
from test_secrets import brute as secret_spans
from test_simhash import brute_components, brute_fingerprint
from test_quality_rules import brute as text_counts

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What every stage got and gave."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in P.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / "rows")
        stage(spark, docs, SF).write.parquet(path)
        given, docs = docs, spark.read.parquet(path)
        out[name] = (given, docs)
    return out


def test_names_and_columns(stages):
    assert [n for n, _ in P.STAGES] == list(stages)
    for given, kept in list(stages.values())[:-1]:
        assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"] and kept.schema.simpleString() == given.schema.simpleString()


def test_quality_drops_what_fails_and_keeps_sound_documents(spark, stages):
    given, kept = stages["quality rules"]
    left = {r.doc_id: r.text for r in kept.collect()}
    rows = given.collect()
    assert all(left[r.doc_id] == r.text for r in rows if r.doc_id in left)
    assert not any(text_counts(r.text)[-1] for r in rows if r.doc_id in left)
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").collect()}
    sound = [r.doc_id for r in rows if r.doc_id in good and not text_counts(r.text)[-1]]
    assert sum(d in left for d in sound) >= 0.99 * len(sound)


def test_one_document_of_each_group_stays(stages):
    given, kept = stages["SimHash near-dedup"]
    fps = [(r.doc_id, brute_fingerprint(r.text)) for r in given.select("doc_id", "text").collect()]
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(set(brute_components(fps)))


def test_secrets_are_gone_and_nothing_else(stages):
    given, kept = stages["secret scans"]
    before = {r.doc_id: r for r in given.collect()}
    after = {r.doc_id: r for r in kept.collect()}
    assert set(before) == set(after)
    for d, old in before.items():
        new = after[d]
        assert new.n_chars == len(new.text)
        if new.text == old.text:
            assert not secret_spans(old.text)
        else:
            assert not any(old.text[a:b] in new.text for _, a, b in secret_spans(old.text))
            pattern = ".+?".join(map(re.escape, re.split(r"\[(?:ASSIGN|ACCESS|HEX|LEARNED)\]", new.text)))
            assert re.fullmatch(pattern, old.text, re.S)


def test_mix_takes_documents_by_weight(stages):
    given, kept = stages["mixing sources to target weights"]
    rows = {r.doc_id: r for r in given.collect()}
    taken = Counter(r.doc_id for r in kept.collect())
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for d, r in rows.items()}
    assert set(taken) <= set(rows) and max(taken.values()) <= 2
    total, budget = sum(size[d] * n for d, n in taken.items()), 1.5 * sum(size.values())
    assert budget - 2 * max(size.values()) <= total <= budget
    names = sorted({r.source for r in rows.values()})
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    by = Counter()
    for d, n in taken.items():
        by[rows[d].source] += n * size[d]
    own = Counter()
    for d, r in rows.items():
        own[r.source] += size[d]
    free = [s for s in names if by[s] < 1.9 * own[s]]
    level = [by[s] / weight[s] for s in free]
    assert not free or max(level) - min(level) <= max(size.values())


def test_packed_sequences_hold_every_token(stages):
    given, pieces = stages["packing"]
    rows = given.collect()
    once = {r.doc_id: r.text for r in rows}
    copies = Counter(r.doc_id for r in rows)
    tokens = Counter()
    for p in pieces.collect():
        tokens[p.doc_id] += p.length
        assert p.length == len(p.ids)
    own = {p.doc_id: p.doc_tokens for p in pieces.collect()}
    assert tokens == Counter({d: own[d] * n for d, n in copies.items()}) and set(own) == set(once)


def test_run_gives_the_last_stage(spark, stages):
    columns = stages["packing"][1].columns
    assert P.run(spark, "/root/testdata/sf0.001").columns == columns and callable(check_sequences)


def odd_documents(spark):
    """Nulls in every column, empty and repeated rows, shared ids, clashing extra columns, and enough sound texts."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghiklmnoprst") for _ in range(rng.randrange(3, 9)))
    text = lambda n: "\n".join(" ".join(word() for _ in range(10)).capitalize() + "." for _ in range(n))
    rows = [(i, text(8 + i % 5), "en", f"s{i % 3}", 1) for i in range(60)]
    rows += [rows[5], rows[5], (5, text(9), "en", "s1", 1), (None, text(9), None, None, None), (None, None, None, None, None), (70, "", "en", "s0", 0), (71, None, "en", "s0", None)]
    rows += [(80, text(9) + f"\npassword = {'x1' * 10}", "en", "s2", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, key int, h long, taken long, size long"
    return spark.createDataFrame([(*r, "r", 1, 2, 3, 4) for r in rows], schema), rows


def test_stages_take_odd_rows_and_keep_extra_columns(spark, tmp_path):
    docs, rows = odd_documents(spark)
    columns = docs.columns
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        given, docs = docs, spark.read.parquet(str(tmp_path / name))
        if name == "SimHash near-dedup":
            kept = [r.text for r in docs.collect()]
            assert len(set(kept)) == len(kept) and set(kept) == {r.text for r in given.collect()}
        if name == "secret scans":
            assert docs.count() == given.count() and not any("x1x1" in r.text for r in docs.collect())
    assert {r.doc_id for r in docs.collect()} <= {r[0] for r in rows} and docs.count() > 0


def test_stages_on_an_empty_table(spark):
    docs = odd_documents(spark)[0].limit(0)
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
        docs = docs if name == "packing" else out.limit(0)
