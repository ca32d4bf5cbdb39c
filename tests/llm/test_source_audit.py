"""Source divergence audit against loops in exact integers."""

import random
import re
from collections import Counter, defaultdict

from crawlgrain.llm import source_audit

COLUMNS = ["lang", "source", "part", "item", "value", "rank"]
SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, value string, v int"


def frame(spark, rows):
    return spark.createDataFrame([(i, *r, "x", 5, "y", 1) for i, r in enumerate(rows)], SCHEMA).repartition(6)


def expected(rows, least=30):
    rows = [tuple(x or "" for x in r) for r in rows]
    words = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)]
    docs, counts, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        found = Counter(words(text))
        docs[lang].update(found.keys())
        counts[lang, source].update(found)
        sources[lang].add(source)
    out = set()
    for lang in sources:
        kept = [t for t, n in docs[lang].items() if n >= least]
        v = len(kept)
        total = Counter()
        for s in sources[lang]:
            total.update(counts[lang, s])
        share = lambda c, n: 1 + 1000000000 * (c + 5) // (n + 5 * v)  # noqa: B023, E731
        p = {s: {t: share(counts[lang, s][t], sum(counts[lang, s][k] for k in kept)) for t in kept} for s in sources[lang]}
        q = {t: share(total[t], sum(total[k] for k in kept)) for t in kept}
        for s in sources[lang]:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources[lang] if o != s]
            terms = [(q[t] - p[s][t], t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:50])):
                out |= {(lang, s, part, i.decode(), -f, k) for k, (f, i) in enumerate(found, 1)}
    return out


def made(seed, langs, n_sources, n):
    random.seed(seed)
    vocabulary = [f"w{c}" + "abcdefghij"[i % 10] * (1 + i // 10) for c in "xyz" for i in range(40)] + ["Ünder", "ünder", "日本", "naïve", "\U0001f600"]
    rows = []
    for _ in range(n):
        source = f"s{min(random.randrange(n_sources), random.randrange(n_sources))}"
        weights = [1 + hash_of(source + w) % 9 for w in vocabulary]
        words = random.choices(vocabulary, weights, k=random.randint(0, 40))
        rows.append((random.choice([" ", "-", "1", "\n"]).join(w.upper() if random.random() < 0.2 else w for w in words), random.choice(langs), source))
    return rows


def hash_of(s):
    return sum(ord(c) * 31**i for i, c in enumerate(s)) % 1009


def test_audit_against_loops(spark):
    rows = made(12, ["en", "de", None, "no"], 7, 400) + [(None, "en", "quiet"), ("", "", None), (None, None, None), ("lonely words", "xx", "only"), ("one", "yy", "a"), ("two", "yy", "b")]
    rows += rows[:20]
    got = source_audit.audit(frame(spark, rows)).select(*COLUMNS).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == expected(rows)
    assert [tuple(r) for r in got if r["lang"] == "yy"] and all(r["value"] == 0 for r in got if r["lang"] == "yy")


def test_audit_with_more_blocks_and_chunks(spark, monkeypatch):
    rows = made(13, ["en", "fr"], 25, 600)
    monkeypatch.setattr(source_audit, "BLOCK", 4)
    monkeypatch.setattr(source_audit, "CHUNK", 16)
    got = source_audit.audit(frame(spark, rows), 20).select(*COLUMNS).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == expected(rows, 20)


def test_audit_of_long_texts_and_no_rows(spark):
    rows = [("alpha beta " * 600_000 + "rare", "en", "long"), ("x" * 5_000_000, "en", "word"), *(("Alpha beta gamma", "en", "a") for _ in range(30))]
    got = {tuple(r) for r in source_audit.audit(frame(spark, rows)).select(*COLUMNS).collect()}
    assert got == expected(rows)
    empty = source_audit.audit(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == [] and set(empty.columns) == set(COLUMNS)
