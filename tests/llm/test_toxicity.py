import random

from tickloom.llm import toxicity as x

CLEAN = ["the {} report needs {} more sessions", "we resampled the {} bars before session {}", "family {} keeps {} rules after costs", "the stop was {} ticks too tight on {}", "please compare {} with the prototype at minute {}", "drawdown reached {} r on {} and held"]
TOXIC = ["{} is a worthless piece of garbage and {} knows it", "shut up you pathetic moron {} {}", "people like {} should be thrown out of town {}", "i will find you {} and break your {}"]


def scored(documents, labels, keep=()):
    texts = x.prepared(documents, keep)
    return x.scores(texts, x.train(texts, labels), keep)


def corpus(seed, n=600, rate=0.25):
    rng = random.Random(seed)
    fill = lambda t: t.format(rng.choice(["alpha", "beta", "gamma", "delta"]), rng.randrange(10, 99))
    docs, truth = [], {}
    for i in range(n):
        lines = [fill(rng.choice(CLEAN)) for _ in range(rng.randrange(3, 9))]
        truth[i] = rng.random() < rate
        if truth[i]:
            bad = fill(rng.choice(TOXIC))
            if rng.random() < 0.3:
                bad = bad.replace("o", "0").replace("e", "3", 1)
            lines.insert(rng.randrange(len(lines)), bad.upper() if rng.random() < 0.2 else bad)
        docs.append((i, ".\n".join(lines), "s1" if i % 3 else None))
    return docs, truth


def test_normalise():
    assert x.normalise("Dаmn") == "damn"  # a Cyrillic letter
    assert x.normalise("h3ll0 s-t-u-p-i-d niiiiice") == "hello stupid nice"
    assert x.normalise("at 12:30 E27 lost 4.5% on Q5-ab12") == "at 9 9 lost 9 on 9"


def test_every_part_is_in_a_window():
    text = " ".join(f"w{chr(97 + i % 26)}o{chr(97 + i // 26)}rd" for i in range(300))
    joined = " ".join(x.windows(text))
    assert all(w in joined for w in text.split())
    assert x.windows(None) == [] and x.windows("?") == [] and x.windows("die scum") == ["die scum"]


def test_held_out_accuracy(spark):
    docs, truth = corpus(1, 1600, 0.08)
    rng = random.Random(2)
    labels = [(i, ("abusive" if truth[i] else "clean") if rng.random() > 0.03 else "hateful", "r", None) for i in range(800)] + [(1, "unsure", "r", None), (2, None, "r", None), (None, "clean", "r", None)]
    d = spark.createDataFrame(docs + [(9001, None, "s1"), (9002, "", None), (9003, "x" * 200_000, "s1")], "doc_id bigint, text string, source string")
    lab = spark.createDataFrame(labels, "doc_id bigint, label string, reviewer string, labelled_ts timestamp")
    got = {r.doc_id: r for r in scored(d, lab, ("source",)).collect()}
    assert len(got) == len(docs) + 3
    flagged = {i for i in range(800, 1600) if got[i].flagged}
    real = {i for i in range(800, 1600) if truth[i]}
    assert len(flagged & real) >= 0.9 * len(real) and len(flagged & real) >= 0.9 * len(flagged)
    assert not got[9001].flagged and got[9001].score == 0 and not got[9002].flagged and not got[9003].flagged


def test_short_texts_and_lines_count(spark):
    rng = random.Random(13)
    lines = ["good catch", "ship it", "hold on", "no idea why", "same here", "makes sense"]
    docs = [(i, "\n".join(rng.sample(lines, 3) + (["you moron"] if i % 8 == 0 else [])), "s1") for i in range(800)] + [(900, "you moron", "s1"), (901, "ship it", "s1")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    labels = spark.createDataFrame([(i, "abusive" if i % 8 == 0 else "clean", "r", None) for i in range(400)], "doc_id bigint, label string, reviewer string, labelled_ts timestamp")
    flagged = {r.doc_id for r in scored(d, labels).where("flagged").collect()}
    assert flagged == {i for i in range(800) if i % 8 == 0} | {900}


def test_without_labels(spark):
    docs, _ = corpus(3, 20)
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    none = spark.createDataFrame([], "doc_id bigint, label string, reviewer string, labelled_ts timestamp")
    got = scored(d, none).collect()
    assert len(got) == 20 and not any(r.flagged for r in got) and {r.score for r in got} == {0.0}


def held_out(spark, docs, truth, seed, every=2):
    """Labels for the first half; (flagged, truly toxic) of the rest."""
    rng = random.Random(seed)
    half = len(docs) // 2
    labels = [(i, ("abusive" if truth[i] else "clean") if rng.random() > 0.03 else ("clean" if truth[i] else "abusive"), "r", None) for i in range(0, half, every)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    lab = spark.createDataFrame(labels, "doc_id bigint, label string, reviewer string, labelled_ts timestamp")
    got = {r.doc_id for r in scored(d, lab).where("flagged").collect()}
    return {i for i in got if i >= half}, {i for i in range(half, len(docs)) if truth[i]}


def test_common_toxic_content(spark):
    flagged, real = held_out(spark, *corpus(5, 1600, 0.25), 6)
    assert len(flagged & real) >= 0.9 * len(real) and len(flagged & real) >= 0.9 * len(flagged)


def test_a_third_are_copies_of_one_abusive_text(spark):
    docs, truth = corpus(7, 1600, 0.05)
    text = "You are a spineless parasite and everybody here despises you.\nCrawl back under your rock, filthy vermin"
    for i in range(0, len(docs), 3):
        docs[i], truth[i] = (i, text, docs[i][2]), True
    flagged, real = held_out(spark, docs, truth, 8, 1)
    copies = set(range(801, len(docs), 3))
    assert copies <= flagged
    assert len(flagged & real) >= 0.9 * len(real) and len(flagged & real) >= 0.9 * len(flagged)


def test_a_rare_toxic_window_is_learnt_beside_many_evident_ones(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(3))
    docs = [(i, "\n".join(rng.choice(CLEAN).format(word(), word()) for _ in range(4)) + (f"\nyou are a worthless moron {word()} and {word()}" if i < 300 else ""), "s1") for i in range(900)]
    docs.append((900, docs[400][1] + "\nverschwinde du nichtsnutziger lump", "s1"))
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    labels = spark.createDataFrame([(i, "abusive" if i < 300 or i == 900 else "clean", "r", None) for i in range(901)], "doc_id bigint, label string, reviewer string, labelled_ts timestamp")
    assert b"verschwinde du nichtsnutziger lump" in x.train(x.prepared(d), labels).toxic


def test_background_counts_cover_all_documents(spark):
    docs = [(i, f"plain words number {i}\nthe shared sentence of many", "s1") for i in range(400)] + [(400 + i, "one copied text with many copies", "s1") for i in range(50)] + [(None, "the shared sentence of many", "s1"), (999, None, "s1")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    counts, n = x.background(x.prepared(d), [0, 1], ["the shared sentence", "one copied text", "never seen at"])
    assert n == 3 and counts == {"the shared sentence": 2, "one copied text": 1}  # numbers are all alike when normalised


def test_background_beyond_a_sample_counts(spark):
    """A harmless sentence that toxic documents happen to hold is frequent only outside the documents with the least hashes."""
    docs, _ = corpus(11, 900, 0)
    toxic = set(range(0, 60))
    docs = [(i, t + (f"\n{TOXIC[i % 4].format('alpha', i)}" + ("\nkindly mind the closing auction" if i % 2 else "") if i in toxic else ""), s) for i, t, s in docs]
    rest = spark.range(300, 900).selectExpr("id", "xxhash64(id) as h").orderBy("h").limit(100).collect()
    early = {r.id for r in rest}
    docs = [(i, t + ("\nkindly mind the closing auction" if i >= 300 and i not in early and i % 2 else ""), s) for i, t, s in docs]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    labels = spark.createDataFrame([(i, "abusive" if i in toxic else "clean", "r", None) for i in range(300)], "doc_id bigint, label string, reviewer string, labelled_ts timestamp")
    assert b"closing auction" not in x.train(x.prepared(d), labels, per_class=100).toxic
