"""Queries that SQL cannot say, against plain loops over the same tables."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from velkora.functions import grammar, morphology
from velkora.functions.text import letter_words
from velkora.plans import queries as core

import __spark_entry__  # noqa: F401  (registers the queries)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    rows = core.table(spark, SF, "documents").select("doc_id", "text", letter_words(F.col("text")).alias("w")).collect()
    return [(r.doc_id, r.text, r.w or []) for r in rows if r.text is not None]


def rows(spark, name):
    return core.QUERIES[name](spark, SF).collect()


def test_morphemes_of_all_words(spark, texts):
    words = {w for *_, ws in texts for w in ws}
    want = {w: (" ".join(morphology.decompose(w)), morphology.known_stem(w)) for w in words}
    got = {r.word: (r.morphemes, r.known) for r in rows(spark, "morph_decompose")}
    assert got == want and len(got) > 500


def test_unknown_rates(spark, texts):
    d = morphology.Dictionary()
    got = {r.doc_id: (r.n_content, r.unknown_rate) for r in rows(spark, "unknown_word_rate")}
    want = {}
    for i, _, ws in texts:
        content = [w for w in ws if not morphology.closed_class(w.lower()) and w.isalpha()]
        loose = morphology.Dictionary(max_roots=99)
        bad = sum(not (morphology.known_stem(w, d) or morphology.known_stem(w, loose)) for w in content)
        if content:
            want[i] = (len(content), round(bad / len(content), 6))
    assert got == want


def parsed(text):
    diags, found, n, clean = [], [], 0, 0
    for m in grammar.SENTENCE.finditer(text):
        ts = grammar.analyse(m.group(), m.start())
        if not ts:
            continue
        parts = [ts[a:b] for a, b in grammar.clauses(ts)]
        bad = [x for c in grammar.CHECKS.values() for p in ([ts] if c in grammar.WHOLE else parts) for x in c(p)]
        got = [x for p in parts for x in grammar.claims(p)]
        n, clean = n + 1, clean + (bool(got) and not bad)
        diags += bad
        found += got
    return diags, found, n, clean


def test_diagnostics_claims_and_rates(spark, texts):
    all_ = {i: parsed(t) for i, t, _ in texts}
    got = Counter((r.doc_id, r.check, r.start, r.end, r.text) for r in rows(spark, "verifier_diagnostics"))
    assert got == Counter((i, *x) for i, (d, *_) in all_.items() for x in d) and got
    assert {(r.doc_id, r.subject, r.relation, r.object, r.confidence) for r in rows(spark, "claims")} == {(i, *x) for i, (_, c, *_) in all_.items() for x in c}
    assert {r.doc_id: r.rate for r in rows(spark, "parseable_rate")} == {i: round(ok / n, 6) for i, (_, _, n, ok) in all_.items() if n}


def test_phrases_and_stems(spark, texts):
    want = defaultdict(list)
    for i, t, _ in texts:
        for n, m in enumerate(grammar.SENTENCE.finditer(t)):
            ts = grammar.analyse(m.group())
            for k, (a, b) in enumerate(grammar.clauses(ts)):
                inside = grammar.in_prepositional(ts[a:b])
                for _, head in grammar.noun_phrases(ts[a:b]):
                    want[i, "pp" if head in inside else "np"].append((n, k))
    got = {(r.doc_id, r.kind): (r.n, r.n_clauses) for r in rows(spark, "noun_phrases")}
    assert got == {k: (len(v), len(set(v))) for k, v in want.items()}
    parser = morphology.DictionaryParser()
    stems = {i: {"".join(p.prefixes) + p.root for w in ws if (p := parser.parse(w))} for i, _, ws in texts}
    stems = {i: {x for x in s if len(x) >= 2} for i, s in stems.items()}
    assert {r.doc_id: r.n for r in rows(spark, "content_stem_counts")} == {i: len(s) for i, s in stems.items() if s}


def test_claim_overlap(spark):
    prose = {r.trace_id: r.text for r in rows(spark, "realize_trace")}
    parts = defaultdict(list)
    for r in rows(spark, "realize_events"):
        parts[r.trace_id].append((r.island, r.text))
    want = {}
    for i, text in prose.items():
        full = {x[:3] for x in parsed(text)[1]}
        part = {x[:3] for x in parsed(" ".join(t for _, t in sorted(parts[i])))[1]}
        part |= {(o, "est", s) for s, r, o in part if r == "est"}
        if full:
            want[i] = (len(full), len(full & part))
    assert {r.trace_id: (r.n, r.shared) for r in rows(spark, "claim_overlap")} == want


def test_plans_are_real(spark):
    """Every plan leads from the start to the goal along moves of its trace."""
    edges = defaultdict(set)
    for r in core.table(spark, SF, "trace_relations").collect():
        a, b = r.args[0], r.args[1]
        edges[r.trace_id] |= {(a, b), (b, a)}
    first = {r[0]: r[1] for r in core.table(spark, SF, "trace_entities").groupBy("trace_id").agg(F.min("eid")).collect()}
    seen = 0
    for r in rows(spark, "plan_search"):
        at = first[r.trace_id]
        for step in r.plan:
            a, b = step[3:-1].split(">")
            assert a == at and (a, b) in edges[r.trace_id]
            at = b
        assert not r.found or f"at|{at}" == r.goal
        assert len(r.plan) == r.n_steps
        seen += r.found
    assert seen


def test_pair_merges(spark):
    words = [(list(r.word), int(r.per_million)) for r in core.table(spark, SF, "common_words").collect()]
    want = []
    for rank in range(8):
        n = Counter()
        for w, c in words:
            for p in zip(w, w[1:], strict=False):
                n[p] += c
        (a, b), c = min(n.items(), key=lambda x: (-x[1], x[0]))
        want.append((rank, a, b, c))
        for w, _ in words:
            i = 0
            while i + 1 < len(w):
                if (w[i], w[i + 1]) == (a, b):
                    w[i : i + 2] = [a + b]
                i += 1
    assert [tuple(r) for r in rows(spark, "bpe_pair_counts")] == want


def test_gzip_counts_every_byte(spark):
    import zlib

    by = defaultdict(list)
    for r in core.table(spark, SF, "documents").where("text is not null and site is not null").select("site", "text").collect():
        by[r.site].append(r.text.encode())
    got = {r.site: r for r in rows(spark, "gzip_diversity")}
    assert {k: r.raw for k, r in got.items()} == {k: sum(map(len, v)) for k, v in by.items()}
    for k, r in got.items():  # small groups are one stream, in the order of their texts
        assert r.packed == len(zlib.compress(b"".join(sorted(by[k])), 9))
