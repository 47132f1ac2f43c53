"""The expression language and its answers against SQLite's own full text."""

import random
import sqlite3

import pytest

from spanloom.operators import fulltext
from spanloom.plans import context
from spanloom.plans.match import COMMIT_COLUMNS, MatchError, parse_match

WORDS = ["ant", "bee", "cat", "dog", "elk", "eland", "fox"]


def expression(rng, depth=2):
    """A random expression, as SQLite's grammar has it."""
    phrase = lambda: rng.choice([rng.choice(WORDS), f'"{" ".join(rng.choices(WORDS, k=rng.randint(1, 3)))}"', f"{rng.choice(WORDS)} + {rng.choice(WORDS)}", f"{rng.choice(['el', 'c', 'e'])}*", f"^{rng.choice(WORDS)}", f'"{rng.choice(WORDS)} e" *'])
    near = lambda: f"NEAR({' '.join(p for p in (phrase().lstrip('^') for _ in range(rng.randint(1, 3))))}{rng.choice(['', ', 0', ', 1', ', 3'])})"
    filtered = lambda x: rng.choice(["", "", "", "subject: ", "{subject body} : ", "- body : ", "-{sha subject}: "]) + x
    if not depth or rng.random() < 0.3:
        return " ".join(filtered(rng.choice([phrase, phrase, near])()) for _ in range(rng.randint(1, 2)))
    if rng.random() < 0.3:
        return filtered(f"({expression(rng, depth - 1)})")
    return f" {rng.choice(['AND', 'OR', 'NOT'])} ".join(expression(rng, depth - 1) for _ in range(rng.randint(2, 3)))


def test_against_sqlite(spark):
    db = sqlite3.connect(":memory:")
    try:
        db.execute("create virtual table t using fts5(sha, subject, body, tokenize='unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("this SQLite has no full text")
    rng = random.Random(11)
    text = lambda n: " ".join(rng.choices(WORDS, k=rng.randint(0, n)))
    docs = [(f"s{k}", text(4), text(25)) for k in range(60)]
    docs += [("résumé", "résumé cafÉ", "İx ṁay ạ ạ"), ("x1", "it's a_b C++", "ant-bee")]
    db.executemany("insert into t values (?, ?, ?)", docs)
    frame = spark.createDataFrame(docs, "sha string, subject string, body string")
    asked, want = [], {}
    queries = [expression(rng) for _ in range(150)] + ["resume", "ix", "may", "a", "cafe", "ant bee NOT cat dog", 'ant "" bee', "NEAR(ant)"]
    for k, q in enumerate(queries):
        try:
            rows = [r[0] for r in db.execute("select sha from t where t match ? order by rank, sha", (q,))]
        except sqlite3.OperationalError:
            with pytest.raises(MatchError):
                parse_match(q, COMMIT_COLUMNS)
            continue
        try:
            asked += [(k, 0, p) for p in parse_match(q, COMMIT_COLUMNS)]
        except MatchError as e:
            assert "alternatives" in str(e)
            continue
        want[k] = set(rows)
    wanted = context.phrase_table(spark, asked)
    stored = fulltext.TextIndex(fulltext.lengths_of(frame, "sha", COMMIT_COLUMNS), fulltext.index(frame, "sha", COMMIT_COLUMNS), "sha")
    for ix in (fulltext.scanned(frame, wanted, "sha", COMMIT_COLUMNS), stored):
        got = {k: set() for k in want}
        for r in fulltext.search_expressions(ix, wanted, 1000).collect():
            got[r.query_id].add(r.sha)
        assert [(queries[k], got[k] ^ want[k]) for k in want if got[k] != want[k]] == []
    assert len(want) > 100 and sum(map(bool, want.values())) > 60


def test_scores_against_sqlite(spark):
    """Order and weights of BM25, with the frequencies of phrases under NEAR and column filters."""
    db = sqlite3.connect(":memory:")
    try:
        db.execute("create virtual table t using fts5(sha, subject, body, tokenize='unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("this SQLite has no full text")
    rng = random.Random(12)
    docs = [(f"s{k}", " ".join(rng.choices(WORDS[:3], k=2)), " ".join(rng.choices(WORDS, k=rng.randint(1, 30)))) for k in range(80)]
    db.executemany("insert into t values (?, ?, ?)", docs)
    frame = spark.createDataFrame(docs, "sha string, subject string, body string")
    queries = ["elk fox", '"elk fox"', "subject: ant fox", "NEAR(elk fox, 2)", "NEAR(elk fox, 2) ant", "body: (dog OR e*) NOT cat", "^dog", "fox OR subject:cat", "elk + fox OR eland"]
    wanted = context.phrase_table(spark, [(k, 0, p) for k, q in enumerate(queries) for p in parse_match(q, COMMIT_COLUMNS)])
    got = {}
    for r in fulltext.search_expressions(fulltext.scanned(frame, wanted, "sha", COMMIT_COLUMNS), wanted, 1000).collect():
        got.setdefault(r.query_id, {})[r.sha] = r.score
    for k, q in enumerate(queries):
        want = dict(db.execute("select sha, rank from t where t match ?", (q,)))
        assert got.get(k, {}).keys() == want.keys() and all(abs(got[k][s] - want[s]) < 1e-9 + 1e-6 * abs(want[s]) for s in want), q


def test_subject_grams(spark):
    """Candidates by pieces, held against the terms: what a look at every subject finds, with short terms and repeated pieces."""
    rng = random.Random(5)
    subjects = [(f"s{k}", "".join(rng.choices(["a", "B", "é", "ab", " "], k=rng.randint(0, 12))), k) for k in range(300)] + [("n", None, 300)]
    commits = spark.createDataFrame(subjects, "sha string, subject string, ord int")
    asked = [(0, ["aba", "BÉ", "a"]), (1, ["aaaa", "ababab", "zzz"]), (2, [" a b"]), (3, [])]
    q = spark.createDataFrame(asked, "query_id int, symbol_terms array<string>")
    want = {(i, sha) for i, terms in asked for sha, s, _ in subjects if s is not None and any(t.lower() in s.lower() for t in terms)}
    grams = context.subject_grams(commits)
    assert {(r.query_id, r.sha) for r in context.subject_hits(commits, q).collect()} == want
    found = context.subject_hits(commits, q, grams, lambda keys: commits.join(keys, "sha", "left_semi")).collect()
    assert {(r.query_id, r.sha) for r in found} == want and len(found) == len(want)
