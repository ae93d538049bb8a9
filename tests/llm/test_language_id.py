import numpy as np

from ledgerlens.llm import language_id as lid

EN = "the house and the garden were in the town with all of that".split()
DE = "der hund und die katze sind nicht in dem haus mit einer frau".split()


def texts(seed, n, size=40):
    rng = np.random.default_rng(seed)
    return [(" ".join(rng.choice(words, size)), lang) for lang, words in (("en", EN), ("de", DE)) for _ in range(n)]


def small_model():
    rows = texts(1, 30)
    return lid.train([t for t, _ in rows], [x for _, x in rows])


def plain_marginals(scores, transitions):
    """Forward-backward over one text, word by word."""
    step = np.exp(transitions - transitions.max())
    likely = np.exp(scores - scores.max(axis=1, keepdims=True)) + 1e-12
    forward, backward = np.zeros_like(likely), np.ones_like(likely)
    message = np.full(scores.shape[1], 1 / scores.shape[1])
    for t in range(len(likely)):
        message = (message @ step) * likely[t]
        message /= message.sum()
        forward[t] = message
    for t in range(len(likely) - 2, -1, -1):
        backward[t] = (likely[t + 1] * backward[t + 1]) @ step.T
        backward[t] /= backward[t].sum()
    out = forward * backward
    return out / out.sum(axis=1, keepdims=True)


def test_blocks_give_the_plain_pass():
    rng = np.random.default_rng(3)
    sizes = [1, 127, 128, 129, 700]
    text = np.repeat([0, 2, 3, 4, 6], sizes)  # texts 1 and 5 have no words
    scores, transitions = rng.normal(size=(len(text), 3)) * 3, rng.normal(size=(3, 3))
    found, moves = lid.marginals(scores, text, transitions)
    for t in set(text):
        assert np.allclose(found[text == t], plain_marginals(scores[text == t], transitions))
    assert np.isclose(moves.sum(), sum(s - 1 for s in sizes))


def test_code_switched_words_are_labelled():
    model = small_model()
    words = lid.find_words([" ".join(EN[:6] * 3 + DE[:6] * 3 + EN[6:] * 2)])
    p, _ = lid.marginals(model.scores(words), words.text, model.transitions)
    label = [model.languages[j] for j in p.argmax(axis=1)]
    truth = ["en"] * 18 + ["de"] * 18 + ["en"] * (2 * len(EN[6:]))
    assert np.mean([a == b for a, b in zip(label, truth)]) > 0.95


def test_held_out_accuracy(spark):
    from ledgerlens.llm.support import ready, table

    docs = table(ready(spark), "/root/testdata/sf0.01", "documents")
    found = lid.predict(docs, lid.learn(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r.held_out]
    assert len(found) == docs.count() and len(held) > 100
    assert np.mean([r.lang == r.lang_pred for r in held]) >= 0.97
    assert all(0 <= r.score <= 1 for r in found)


def test_odd_documents(odd_docs):
    model = small_model()
    found = lid.predict(odd_docs, model).collect()
    assert len(found) == odd_docs.count()
    by_id = {r.doc_id: r for r in found}
    assert {by_id[i].lang_pred for i in (1, 2, 3)} == {"und"} and by_id[1].score == 0
    assert by_id[None].held_out is False
    assert lid.keep_known(odd_docs, model, 0.5).where("doc_id in (1, 2, 3)").count() == 0


def test_no_labels_and_no_rows(docs_of):
    empty = docs_of([])
    model = lid.learn(empty)
    assert lid.predict(empty, model).count() == 0
    assert [r.lang_pred for r in lid.predict(docs_of([(1, "some words")]), model).collect()] == ["und"]


def test_clashing_columns_travel(docs_of):
    docs = docs_of([(1, "the house and the garden")]).selectExpr("*", "'x' as lang_pred", "0.1D as score", "1 as word")
    assert lid.predict(docs, small_model()).columns == ["doc_id", "held_out", "lang_pred", "score"]
    assert lid.keep_known(docs, small_model(), 0.5).columns == docs.columns


def test_runs_of_words_cover_the_text(docs_of):
    text = " ".join(EN) + ". " + " ".join(DE)
    runs = lid.label_words(docs_of([(1, text), (2, None)]), small_model()).orderBy("start").collect()
    assert [r.lang for r in runs] == ["en", "de"] and runs[0].start == 0 and runs[-1].end == len(text)


def test_places_stay_where_lower_case_is_longer():
    words = lid.find_words(["İİ ab", None, "ç"])
    assert words.offset.tolist() == [0, 3, 0] and words.text.tolist() == [0, 0, 2]


def test_unlearned_languages_and_gibberish_are_rejected(spark, docs_of):
    from ledgerlens.llm.support import ready, table

    rows = table(ready(spark), "/root/testdata/sf0.01", "documents").where("text is not null").collect()
    by_lang = {x: [r.text for r in rows if r.lang == x and len(r.text) > 400] for x in ("de", "en", "es", "fr")}
    rng = np.random.default_rng(2)
    gibberish = [" ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(60)) for _ in range(10)]
    for known in (["de", "en", "fr"], ["de"], ["de", "en", "es", "fr"]):
        model = lid.train([t for x in known for t in by_lang[x][:80]], [x for x in known for _ in by_lang[x][:80]])
        mixed = [" ".join(w for at in range(0, 40, 5) for x in known for w in by_lang[x][i].split()[at : at + 5]) for i in range(80, 90)]
        texts = {x: t[80:120] for x, t in by_lang.items()} | {"none": gibberish, "mixed": mixed}
        docs = docs_of([(n, t, x, "s", 0) for x, group in texts.items() for n, t in enumerate(group)])
        kept = {r["lang"]: r["count"] for r in lid.keep_known(docs, model).groupBy("lang").count().collect()}
        for x, group in texts.items():
            share = kept.get(x, 0) / len(group)
            assert share >= 0.95 if x == "mixed" or x in known else share <= 0.05, (known, x, share)
