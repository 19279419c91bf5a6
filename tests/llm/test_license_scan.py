import random

from lexiforge.llm import license_scan as ls

from .cases import SCHEMA, TEXTS, alnum_words, rows


def brute(text):
    words, places, labels = alnum_words(text), [], set()
    for t in ls.PHRASES:
        for i in range(len(words)):
            if tuple(words[i : i + len(t.words)]) == t.words:
                places.append(i)
                labels.add(t.label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def texts():
    rng = random.Random(1)
    parts = ["GNU General", "public license", "gnu general public license", "Apache-License", "CC BY", "by", "MIT", "license.", "mit license", "é", "cc", "\n", "lesser"]
    return TEXTS + [" ".join(rng.choices(parts, k=rng.randrange(1, 40))) for _ in range(80)]


def test_base_equals_brute_force(spark):
    all_ = texts()
    got = {r.doc_id: r for r in ls.scan_licenses(spark.createDataFrame(rows(all_), SCHEMA)).collect()}
    for i, t in enumerate(all_):
        r = got[i]
        assert tuple(r[1:6]) == brute(t), (i, t)
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert (r.score == 0) == (r.labels == "") and 0 <= r.score <= 1
        if r.n_base:
            assert r.score == 1


def test_templates_need_their_key_phrases(spark):
    mit = next(t for t in ls.NOTICES if t.name == "mit-grant").words
    changed = list(mit)
    changed[30] = "whatever"
    inserted = [*mit[:20], "inserted", "words", *mit[20:]]
    no_key = [w if w not in ("without", "restriction") else "x" for w in mit]
    cases = [" ".join(mit), "before it " + " ".join(changed) + " after", " ".join(inserted), " ".join(no_key), "permission is granted"]
    got = sorted(ls.scan_licenses(spark.createDataFrame(rows(cases), SCHEMA)).collect())
    assert [r.labels for r in got] == ["mit", "mit", "mit", "", ""]
    assert got[0].score == 1 and 0.9 < got[1].score < 1


def test_every_template_is_found(spark):
    rng = random.Random(4)
    prose = lambda n: " ".join(rng.choices(["of", "the", "river", "and", "software", "license", "use"], k=n))
    whole = [t for t in ls.NOTICES if len(t.words) > 12]
    cases = [f"{prose(40)} {' '.join(t.words)} {prose(40)}" for t in whole]
    # A few words changed, and two inserted after the first key phrase.
    for t in whole:
        w, free = list(t.words), [i for i in range(len(t.words)) if not any(a <= i < a + n for a, n in t.keys)]
        for i in rng.sample(free, len(free) // 8):
            w[i] = "changed"
        a = sum(t.keys[0])
        cases.append(prose(30) + " " + " ".join(w[:a] + ["two", "more"] + w[a:]))
    cases += [prose(200) for _ in range(40)]
    got = sorted(ls.scan_licenses(spark.createDataFrame(rows(cases), SCHEMA)).collect())
    for r, t in zip(got, whole * 2):
        assert t.label in r.labels.split(","), t.name
    assert all(r.labels == "" for r in got[2 * len(whole) :])
    assert all(r.score == 1 for r in got[: len(whole)])


def test_rare_words_are_rare_in_the_documents(spark):
    common = "merchantability noninfringement sublicense person"
    df = spark.createDataFrame(rows([common + f" word{k}" for k in range(30)] + [None, ""]), SCHEMA)
    frequency, n = ls.frequencies(df, ls.NOTICES)
    assert n == 32 and frequency["sublicense"] == 30 and frequency["tort"] == 0
    index = ls.Index(ls.NOTICES, frequency, n)
    k = [t.name for t in ls.NOTICES].index("mit-text")
    rare = {ls.NOTICES[k].words[i] for i in index.rare[k]}
    assert len(rare) == ls.RARE_WORDS and not rare & set(common.split())


def test_empty_table(spark):
    assert ls.scan_licenses(spark.createDataFrame([], SCHEMA)).count() == 0
