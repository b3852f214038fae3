"""The training-data operators against brute force, round trips and hand-made cases."""

import random
from collections import Counter
from datetime import datetime
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from umbra.llm import consensus, encoding, leakage, mixing, overlap, pairs, sanitise, splitter
from umbra.llm.words import words

DAY = datetime(2024, 1, 1)


# ---------------------------------------------------------------- words
def test_words_fold_case_accents_markup_and_notes():
    assert words("<b>Café</b>,  STRASSE&amp;straße [12] x²  ﬁn­") == ["cafe", "strasse", "strasse", "x", "fin"]
    assert words(None) == [] and words("  ") == []


# ---------------------------------------------------------------- p1
ANNOTATION = "ann_id long, uid string, annotator string, start int, end int, label string, text string, confidence double, made_at timestamp, received_at timestamp, n_marked string"


def marks(spark, rows):
    return spark.createDataFrame([(n, uid, who, s, e, label, None, None, DAY, DAY, "clash") for n, (uid, who, s, e, label) in enumerate(rows)], ANNOTATION)


def simulated(spark, items=150):
    """Three careful annotators and two that call every address and number a code, who outvote a single careful one."""
    rng, rows, truth = random.Random(1), [], {}
    for n in range(items):
        label = consensus.LABELS[n % 9]
        truth[f"u{n}"] = label
        good = rng.sample(["g1", "g2", "g3"], 3 if n % 4 else 1)
        for who in good + ["b1", "b2"]:
            given = label
            if who[0] == "b" and label in ("EMAIL", "PHONE", "ID_NUMBER"):
                given = "CODE" if rng.random() < 0.9 else label
            rows.append((f"u{n}", who, 2, 6, given.lower().replace("_", "-")))
    records = spark.createDataFrame([(u, "0123456789") for u in truth], "uid string, text string")
    return marks(spark, rows), records, truth


def test_consensus_beats_the_majority_and_paths_agree(spark):
    annotations, records, truth = simulated(spark)
    sent = {r["uid"]: r["label"] for r in consensus.Consensus(annotations, records, rounds=4).cases().collect()}
    right = sum(sent[u] == truth[u] for u in truth)
    votes = {}
    for r in annotations.collect():
        votes.setdefault(r["uid"], Counter())[r["label"].upper().replace("-", "_")] += 1
    by_majority = sum(v.most_common(1)[0][0] == truth[u] for u, v in votes.items())
    assert right >= 0.97 * len(truth) and right > by_majority
    joined = consensus.Consensus(annotations, records, rounds=2, limit=2)
    assert joined.fit.table is not None
    kept = consensus.Consensus(annotations, records, rounds=2)
    assert {tuple(r) for r in joined.cases().select("uid", "label").collect()} == {tuple(r) for r in kept.cases().select("uid", "label").collect()}
    trust = {r["annotator"]: r["reliability"] for r in kept.annotators().collect()}
    assert min(trust[g] for g in ("g1", "g2", "g3")) > max(trust["b1"], trust["b2"])


def test_mentions_spans_and_unusable_rows(spark):
    rows = [
        ("u", "a", 0, 4, "PERSON"), ("u", "b", 0, 4, " person "), ("u", "c", 2, 6, None), ("u", "a", 9, 5, "ORG"), ("u", "b", 5, 99, "ORG"),
        ("u", "a", 7, 9, "ORG"), ("gone", "a", 0, 1, "ORG"), (None, "a", 0, 1, "ORG"), ("u", None, 0, 1, "ORG"), ("u", "a", -1, 2, "ORG"), ("v", "a", 0, 2, None),
    ]
    annotations = marks(spark, rows)
    annotations = annotations.unionByName(annotations)  # everything delivered again
    records = spark.createDataFrame([("u", "0123456789"), ("v", "😀x"), ("w", None)], "uid string, text string")
    made = consensus.Consensus(annotations, records, rounds=1)
    assert {tuple(r) for r in made.cases().select("uid", "start", "end", "label", "n_marked", "n_annotators").collect()} == {("u", 0, 4, "PERSON", 3, 3), ("v", 0, 2, None, 1, 1)}
    row = made.agreement().where("uid = 'u'").first()
    assert row["label_agreement"] == 1.0 and row["n_mentions"] == 2 and row["marking_agreement"] == round(4 / 6, 6)
    mixed = marks(spark, [("u", "a", 0, 4, "PERSON"), ("u", "b", 0, 4, "ORG"), ("u", "a", 6, 9, "ORG"), ("u", "b", 6, 9, "ORG")])
    assert consensus.Consensus(mixed, records, rounds=1).agreement().first()["label_agreement_corrected"] == round((0.5 - 10 / 16) / (1 - 10 / 16), 6)
    empty = consensus.Consensus(annotations.limit(0), records, rounds=1)
    assert empty.cases().count() == 0 and empty.agreement().count() == 0


# ---------------------------------------------------------------- p2
RECORD = "idx long, uid string, name string, source string, split string, text string, loaded_at timestamp, n long"


def records_of(spark, texts, splits=None, sources=None):
    rows = [(n, uid, None, (sources or {}).get(uid, "s"), (splits or {}).get(uid, "train"), text, DAY, 1) for n, (uid, text) in enumerate(texts.items())]
    return spark.createDataFrame(rows, RECORD)


PII = {
    "r1": "Mr Otto Belling later confirmed it. Write to otto.belling@mail.example or call +44 20 7946 0123 ext. 4, not to Belling & Sons Ltd.",
    "r2": "Dr Otto Belling (SSN 912-34-5678) lives at Flat 7, 6-8 Ravlon Row, Selton, QQ1 2AB. Case 912-3456789 was lodged.",
    "r3": "Neither Otto Belling nor Rita Halvik signed. Thanks to @martir23, order T-221/63, 12 May 2020, $300.",
    "r4": "belling, otto wrote from o_b [at] box [dot] example; [EMAIL] stays. Das Paket ging an Selvelweg 63a in 04291 Zanlobrook, Bestellung 5.",
    "r5": "", "r6": None, "r7": "😀 Frau Rita Halvik, wohnt in der Normergasse 5, 04291 Norau." + " blah" * 5000,
}


def test_sanitise(spark):
    found = sanitise.sanitise(records_of(spark, PII))
    got = {r["uid"]: [(r["text"][s["start"] : s["end"]], s["label"]) for s in r["spans"]] for r in found.collect()}
    assert ("otto.belling@mail.example", "EMAIL") in got["r1"] and ("+44 20 7946 0123 ext. 4", "PHONE") in got["r1"] and ("Otto Belling", "PERSON") in got["r1"] and len(got["r1"]) == 3
    assert set(got["r2"]) == {("Otto Belling", "PERSON"), ("912-34-5678", "ID_NUMBER"), ("Flat 7, 6-8 Ravlon Row, Selton, QQ1 2AB", "ADDRESS")}
    assert set(got["r3"]) == {("Otto Belling", "PERSON"), ("Rita Halvik", "PERSON")}
    assert ("belling, otto", "PERSON") in got["r4"] and ("o_b [at] box [dot] example", "EMAIL") in got["r4"] and ("Selvelweg 63a in 04291 Zanlobrook", "ADDRESS") in got["r4"]
    assert got["r5"] == [] and "r6" not in got
    assert ("Rita Halvik", "PERSON") in got["r7"]
    out = {r["uid"]: r["text"] for r in sanitise.redacted(records_of(spark, PII)).collect()}
    assert out["r2"].startswith("Dr [PERSON] (SSN [ID_NUMBER]) lives at [ADDRESS]. Case 912-3456789")
    assert sanitise.occurrences(records_of(spark, PII).limit(0)).count() == 0


def test_without_terms_nothing_is_found():
    for text in PII.values():
        assert sanitise.find(text, frozenset(), frozenset()) == []


def test_cues_are_learnt_and_name_the_unknown(spark):
    rng = random.Random(6)
    known = [f"{a}{b}".capitalize() for a in ("bel", "dor", "kar", "lim", "nor", "pel") for b in ("dan", "ris", "tov", "vik", "wen")]
    fresh = [f"Zu{x.lower()}" for x in known]
    rows = {}
    for n in range(240):
        name = f"{rng.choice(known)} {rng.choice(known)}"
        rows[f"t{n}"] = f"Mr {name} left early. The parcel for {rng.choice(known)} {rng.choice(known)} arrived at dawn. Every Tuesday the market was full. The Harbour near Selton was quiet."
    for n in range(30):
        rows[f"n{n}"] = f"The parcel for {fresh[n]} {fresh[-1 - n]} arrived at dawn. The Harbour near Selton was quiet."
    texts = spark.createDataFrame(list(rows.items()), "uid string, text string")
    cues = {r["term"] for r in sanitise.learn_cues(texts).collect()}
    assert "<parcel for" in cues and not any("near" in c.split() for c in cues)
    for limit in (20_000, 0):  # sent or joined
        sanitise.SENT_CUES, kept = limit, sanitise.SENT_CUES
        held = {r["uid"]: set(r["cues"] or ()) for r in sanitise.with_cues(texts, sanitise.learn_cues(texts)).collect()}
        sanitise.SENT_CUES = kept
        assert all("<parcel for" in v for v in held.values())
    found = {r["uid"]: [r["text"][s["start"] : s["end"]] for s in r["spans"]] for r in sanitise.sanitise(records_of(spark, rows)).collect()}
    right = sum(found[f"n{n}"] == [f"{fresh[n]} {fresh[-1 - n]}"] for n in range(30))
    assert right >= 27  # names that no title ever introduced


def test_cues_are_looked_up_and_no_text_without_name_terms_is_parsed(monkeypatch):
    text = "Yesterday Anna Berg rang.\nThe parcel went to Lena de Vos, who lives near Bonn. dear Bob, reply to anna"
    for shown in (text, text.lower(), "", "Anna"):
        held, near = sanitise.held_contexts(shown), sanitise.Contexts(shown)
        words = list(sanitise.name_words(shown))
        for part in (held, set(sorted(held)[::2]), set(), {"<no such", ">went to here", "< x"}):
            assert sanitise.Cues(part).held(shown) == held & part
            told = ({near.at_start[s] for s, *_ in words if part & set(near.before(s))}, {near.at_end[e] for _, e, *_ in words if part & set(near.behind(e))})
            places = near.cued(frozenset(part))
            starts, ends = {near.at_start[s] for s, *_ in words}, {near.at_end[e] for _, e, *_ in words}
            assert (places[0] & starts, places[2] & ends) == told
    monkeypatch.setattr(sanitise, "Contexts", None)
    assert sanitise.find("Write to a.b@c.example, Anna", frozenset(), frozenset(), disclosing=frozenset({"email"})) == [(9, 22, "EMAIL")]


def test_telephone_numbers_of_any_country():
    for value in ("+91 98765 43210", "+81 3-1234-5678", "+55 11 91234 5678", "+420 601 123 456", "0044 20 7946 0123"):
        found = [(k, s, e) for k, s, e, _ in sanitise.forms(f"Please call {value}.") if k == "phone"]
        assert found == [("phone", 12, 12 + len(value))]


def test_redaction_keeps_the_rest():
    text, spans = "a Bob c", [(2, 5, "PERSON")]
    assert sanitise.redact(text, spans) == "a [PERSON] c"


# ---------------------------------------------------------------- p3
def test_defects(spark):
    topics = ["garden", "river", "market", "boss", "tram", "visa", "dog", "exam"]
    rows, expected = [], {}

    def add(response, question, defect=None):
        rows.append((len(rows), response, question, DAY))
        if defect:
            expected[len(rows) - 1] = defect

    for a in topics:
        for b in topics:
            add(f"The {a} of the {b} was near the old {a}. Every {b} liked the {a} and often saw the {b}.", f"What was the best thing about your {a} and the {b}?")
    for a in topics:
        add("I'm sorry, but I cannot help with this request.", f"How do you cope with the {a}?", "refusal")
        add(f"Sorry for the long post! The {a} of the exam was near the old {a}.", f"Who taught you to be kind about the {a}?")
        add(f"Every {a} liked the dog and often saw the", f"Which {a} would you show a visitor?", "truncated")
        add(f"Every {a} liked the dog and often saw the {a}", f"Which {a} would you pick, and why?")
        add("Never had one", f"Tell me about the {a}?")
    add(None, "Why the garden?", "empty")
    add(" [deleted] ", "Why the garden?", "empty")
    add("​", None, "empty")
    add("No.", "Do you like the garden?")
    add("WHY do people  care about the garden", "Why do people care about the garden?", "copies_question")
    add("> Why do people care about the dog?\n\nThe dog was near the old garden.", "Why do people care about the dog?")
    add("Der Hund ist im Garten und die Katze auch nicht.", "Why do you like the dog of your boss?", "other_language")
    add("Every dog liked the garden. C’est la vie.", "What was the best thing about your dog?")
    made = spark.createDataFrame(rows + rows[:5], "post_id long, response string, question_asked string, loaded_at timestamp")
    found = {r["post_id"]: r["defect"] for r in pairs.defects(made).collect()}
    assert found == expected
    assert pairs.defects(made.limit(0)).count() == 0


PHRASES = ("I’ll pass on this one.", "I'd rather not talk about that.", "Dazu sage ich nichts.", "Je préfère ne pas répondre à cette question.", "That topic is private to me.", "Prefiero no hablar de esto.")


def test_refusals_of_other_wording_recur_and_stock_answers_stay(spark):
    topics = ["garden", "river", "market", "boss", "tram", "visa", "dog", "exam"]
    frames = ["How do you cope with the {}?", "Why would anyone want a {} these days?", "Tell me about your {}", "Which {} did you like best?"]
    rows, expected = [], set()
    for phrase in PHRASES:
        for n, topic in enumerate(topics[:4]):
            expected.add(len(rows))
            rows.append((len(rows), phrase, frames[n].format(topic), DAY))
    for n, topic in enumerate(topics):  # apologies and offers that go with any refusal, though it says little
        expected.add(len(rows))
        rows.append((len(rows), f"{('Sorry', 'Unfortunately')[n % 2]}, the answer desk is closed. {('Ask me something else.', 'Have a nice day.')[n % 3 == 0]}", frames[n % 4].format(topic), DAY))
        expected.add(len(rows))
        rows.append((len(rows), f"{('Sorry', 'Unfortunately')[n % 3 == 0]}, the service has been suspended. {('Ask me something else.', 'Have a nice day.')[n % 2]}", frames[n % 4].format(topic), DAY))
    for n, topic in enumerate(topics):
        rows.append((len(rows), "Never had one", frames[n % 4].format(topic), DAY))
        rows.append((len(rows), f"I can't help laughing about that. The {topic} was near the old {topics[n - 1]} of the {topics[n - 3]}.", frames[n % 4].format(topic), DAY))
        rows.append((len(rows), f"The old {topic} burned down after the {topics[n - 2]} closed. C’est la vie.", frames[n % 4].format(topic), DAY))
    made = spark.createDataFrame(rows, "post_id long, response string, question_asked string, loaded_at timestamp")
    assert {r["post_id"] for r in pairs.refusals(pairs._posts(made)).collect()} == expected
    same = made.withColumn("question_asked", F.lit("Why the garden?"))  # one prompt: nothing recurs across prompts
    assert pairs.refusals(pairs._posts(same)).count() == 0


def test_openings_that_differ_in_a_word_are_linked(spark):
    core = ["this is something that nobody in our {} office may ever discuss with you", "my cousin built a {} boat out of bottles for the summer race"]
    rows = [(n * 10 + k, core[n].format(w), 1) for n in range(2) for k, w in enumerate(["small", "large", "other", "quiet", "busy"])] + [(99, "nothing like the others here", 1)]
    openings = spark.createDataFrame(rows, "id long, opening string, n_prompts long")
    found = {r["node"]: r["component"] for r in pairs.components(pairs.opening_links(openings), "id", "head").collect()}
    assert found == {n * 10 + k: n * 10 for n in range(2) for k in range(5)}


def test_components_reach_a_fixed_point(spark):
    chain = spark.createDataFrame([(n, n + 1) for n in range(40)] + [(100, 101)], "a long, b long")
    found = {r["node"]: r["component"] for r in pairs.components(chain, "a", "b").collect()}
    assert found == {n: 0 for n in range(41)} | {100: 100, 101: 100}


def test_question_said_twice_and_languages_told_apart():
    assert pairs.copies("Why the garden?", "Why the garden? why the GARDEN?") and not pairs.copies("Why the garden?", "Why the garden? Because it was near.")
    assert pairs.clear_language("Der Hund ist im Garten und die Katze auch nicht.") == pairs.NAMES.index("de")


def test_nothing_that_grows_with_the_pairs_is_broadcast(spark, monkeypatch):
    plans, cut = [], pairs.cut

    def ran(df, run):
        done = run(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())  # as it was changed while it ran
        return done

    monkeypatch.setattr(pairs, "cut", lambda df: ran(df, cut))
    rows = [(n, "I would rather not discuss this question with you" + " at all" * (n % 2) + ".", f"Question {n} about topic {n * 7}?", DAY) for n in range(6)]
    made = spark.createDataFrame(rows, "post_id long, response string, question_asked string, loaded_at timestamp")
    ran(pairs.defects(made), lambda df: df.collect())
    assert len(plans) > 10 and any("Join" in p for p in plans)
    assert [p for p in plans if "Broadcast" in p] == []


def test_trigrams_of_several_texts_are_those_of_each():
    said = ["Der Hund, ÄRGER!", "", "a", "12 ...", "no no", "İ Σς ß"]
    assert pairs.trigrams(*said).tolist() == [slot for text in said for slot in pairs.trigrams(text).tolist()] and len(pairs.trigrams()) == 0


def test_words_outside_the_lexicon_are_known(spark, monkeypatch):
    rows = []
    for n in range(30):
        rows.append((len(rows), f"Every walker near place{n} saw the river. Nobody liked the tower near the garden.", "What did you see?", DAY))
    rows.append((100, "Many people like the zephyr.", "What do you like?", DAY))
    rows.append((101, "Yesterday every walker in our town saw the zephyr", "What did they see?", DAY))  # a word seen once
    rows.append((102, "Yesterday every walker in our town liked the garden", "What did they like?", DAY))
    rows.append((103, "Yesterday every walker in our town liked the gard", "What did they like?", DAY))
    rows.append((104, "Yesterday every walker in our town liked the Gard", "What did they like?", DAY))
    made = spark.createDataFrame(rows, "post_id long, response string, question_asked string, loaded_at timestamp")
    for size in (20_000, 3):
        monkeypatch.setattr(pairs, "LEXICON", size)
        found = {r["post_id"]: r["defect"] for r in pairs.defects(made).collect()}
        assert found == {103: "truncated", 104: "truncated"}


# ---------------------------------------------------------------- p4
@pytest.mark.parametrize("limit, overlap", [(40, 0), (40, 10), (7, 3), (1, 0), (50, 49)])
def test_pieces_cover_and_overlap(limit, overlap):
    rng = random.Random(limit)
    for _ in range(60):
        text = "".join(rng.choice(["word ", "a", "😀", "\n\n", ". ", "x" * 30, "\n", ", "]) for _ in range(rng.randrange(60)))
        cut = splitter.pieces(text, limit, overlap)
        shared = min(overlap, (limit - 1) // 2)
        assert all(0 < b - a <= limit for a, b in cut)
        assert cut[-1][1] == len(text) and cut[0][0] == 0 if text else cut == []
        for (_, end), (start, _) in zip(cut, cut[1:]):
            assert start == end - shared


def test_pieces_prefer_natural_limits():
    text = "One two three. Four five six.\n\nSeven eight nine ten."
    assert [text[a:b] for a, b in splitter.pieces(text, 35, 0)] == ["One two three. Four five six.\n\n", "Seven eight nine ten."]
    assert [text[a:b] for a, b in splitter.pieces(text, 18, 0)][0] == "One two three. "


def test_titles_and_initials_end_no_sentence():
    text = "The court heard Mr. Belling and J. Halvik. Then it rose."
    assert [text[a:b] for a, b in splitter.pieces(text, 45, 0)] == ["The court heard Mr. Belling and J. Halvik. ", "Then it rose."]


def test_many_chunks_of_one_document(spark, monkeypatch):
    monkeypatch.setattr(splitter, "GROUP", 3)
    body = " ".join(f"word{n}" for n in range(400))
    chunks = spark.createDataFrame([(n, "d" if n % 2 else None, body[n * 20 : n * 20 + 60], n * 20 + 5, "p", "x") for n in range(40)], "chunk_id long, doc_id string, text string, start int, profile string, document string")
    profiles = spark.createDataFrame([("p", 25, 5)], "profile string, max_length int, overlap int")
    docs = spark.createDataFrame([("d", body, DAY)], "doc_id string, text string, delivered_at timestamp")
    rows = splitter.split_chunks(chunks, profiles, docs).collect()
    assert {r["chunk_id"] for r in rows} == set(range(40)) and all(body[r["start"] : r["end"]] == r["text"] for r in rows if r["chunk_id"] % 2)
    whole = {r["chunk_id"]: r["n_chars"] for r in splitter.rebuilt(splitter.split_chunks(chunks, profiles, docs)).collect()}
    assert whole == {n: 60 for n in range(40)}


def test_split_chunks(spark):
    chunks = spark.createDataFrame([(1, "d", "x" * 12, 999, "p"), (1, "d", "x" * 12, 999, "p"), (2, "d", "aa bb cc dd ee", None, "p"), (3, "d", "short", 0, "p"), (4, "e", None, 0, "p"), (5, "zz", "aa bb cc dd ee ff", 0, "q")], "chunk_id long, doc_id string, text string, start int, profile string")
    profiles = spark.createDataFrame([("p", 10, 2)], "profile string, max_length int, overlap int")
    docs = spark.createDataFrame([("d", "--" + "aa bb cc dd ee" + "x" * 12, DAY)], "doc_id string, text string, delivered_at timestamp")
    rows = splitter.split_chunks(chunks, profiles, docs).orderBy("chunk_id", "piece_no").collect()
    assert {(r["chunk_id"], r["kind"]) for r in rows} == {(1, "unbroken"), (2, "splittable")}
    document = "--" + "aa bb cc dd ee" + "x" * 12
    assert all(document[r["start"] : r["end"]] == r["text"] and len(r["text"]) <= 10 for r in rows)


# ---------------------------------------------------------------- p6
def test_suffix_array_and_backward_search():
    rng = np.random.default_rng(3)
    texts = [rng.integers(1, 6, size=40).astype(np.int32) for _ in range(12)]
    index = overlap.Index(overlap.pack_index(texts, [f"{n:032x}" for n in range(12)]))
    order, sequence = index.order.tolist(), index.sequence.tolist()
    assert order == sorted(range(len(sequence)), key=lambda i: sequence[i:] + [-1])
    query = np.concatenate([texts[3][5:25], rng.integers(1, 6, size=10)]).astype(np.int32)
    local = index.local(query)
    begin, length, low, high = index.maximal_matches(local)
    for b, n, lo, hi in zip(begin, length, low, high):
        pattern = local[b : b + n].tolist()
        places = [i for i in range(len(sequence)) if sequence[i : i + n] == pattern]
        assert sorted(index.order[lo:hi].tolist()) == places
    assert length.max() >= 19


def test_overlaps_match_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{n}" for n in range(60)]
    base = {f"t{n}": [rng.choice(vocabulary) for _ in range(rng.randrange(20, 60))] for n in range(40)}
    texts, splits, sources = {u: " ".join(w) for u, w in base.items()}, {}, {}
    for n in range(40):
        source = base[f"t{rng.randrange(20)}"]
        changed = [rng.choice(vocabulary) if rng.random() < 0.12 else w for w in source]
        text = " ".join(changed).upper() if n % 3 else "Note: " + ", ".join(changed)
        texts[f"e{n}"], splits[f"e{n}"], sources[f"e{n}"] = text, ("dev", "TEST", "Validation")[n % 3], "x"
    texts |= {"e90": " ", "e91": None, "t92": "tiny text", "e93": "Tiny, text!", "n94": texts["t0"]}
    splits |= {"e90": "test", "e91": "test", "e93": "test", "n94": None}
    rows = records_of(spark, texts, splits, sources)
    rows = rows.unionByName(rows)
    found = {(r["train_uid"], r["eval_uid"]) for r in overlap.record_pairs(rows).collect()}
    expected = set()
    for a in (u for u in texts if u[0] == "t"):
        for b in (u for u in texts if u[0] == "e"):
            x, y = words(texts[a]), words(texts[b])
            if x and y:
                same = sum(m.size for m in SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks())
                if same >= overlap.SIMILARITY * max(len(x), len(y)):
                    expected.add((a, b))
    assert found == expected and ("t92", "e93") in found
    counts = overlap.overlap_counts(rows).collect()
    assert sum(r["n_pairs"] for r in counts) == len(expected)
    assert overlap.record_pairs(rows.limit(0)).count() == 0


def test_near_copies_beside_an_exact_copy_match_brute_force():
    rng = random.Random(11)
    trained, asked = [], []
    for n in (3, 4, 8, 12, 25, 40, 60, 100):
        for k in range(12):
            text = [rng.randrange(4000) for _ in range(n)]
            near = [list(text) for _ in range(3)]
            for copy, places in zip(near, (rng.sample(range(n), n // 5), rng.sample(range(n), n * 3 // 20), range(3, n, 4))):
                for at in places:
                    copy[at] = 5000 + rng.randrange(4000)
            trained.append(np.array(text, dtype=np.int32))
            asked += [np.array(t, dtype=np.int32) for t in (text, *near, text[: n - n // 4])]
    index = overlap.Index(overlap.pack_index(asked, [f"{n:032x}" for n in range(len(asked))]))
    found = {(number, int(digest, 16)) for number, digest, *_ in index.overlaps(trained)}
    expected = set()
    for a, x in enumerate(trained):
        for b, y in enumerate(asked):
            if len(set(x.tolist()) & set(y.tolist())) > 1:
                same = sum(m.size for m in SequenceMatcher(None, x.tolist(), y.tolist(), autojunk=False).get_matching_blocks())
                if same >= overlap.SIMILARITY * max(len(x), len(y)):
                    expected.add((a, b))
    assert found == expected


# ---------------------------------------------------------------- p7
def test_automaton_finds_all_maximal_matches():
    rng = random.Random(2)
    base = [rng.randrange(3) for _ in range(80)] + [-2] + [rng.randrange(3) for _ in range(40)]
    base += [-3] + base[10:30] + [7] + base[31:50]
    automaton = leakage.SuffixAutomaton(base)
    query = [rng.choice([0, 1, 2, -1]) for _ in range(60)] + base[5:60] + [5]
    expected = set()
    for i in range(len(query)):
        for j in range(len(base)):
            if i and j and query[i - 1] == base[j - 1] >= 0:
                continue
            n = 0
            while i + n < len(query) and j + n < len(base) and query[i + n] == base[j + n] >= 0:
                n += 1
            if n >= leakage.ANCHOR:
                expected.add((i, j, n))
    found = automaton.maximal_matches(query)
    assert set(found) == expected and len(found) == len(expected) and any(n >= 50 for *_, n in found)


def test_leaks(spark):
    rng = random.Random(4)
    vocabulary = [f"word{n}" for n in range(400)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    instruction = "read the following extract and answer with one word only please".split()
    items = {n: instruction + text(60) for n in range(6)}
    filler = lambda: " ".join(text(30))
    docs, expected = {}, set()
    for n in range(6):
        body = items[n][len(instruction) :]
        changed = [w if i % 11 else "typo" for i, w in enumerate(body[5:35], 1)]
        docs[n * 10] = f"{filler()} <p>{', '.join(changed).upper()}</p> {filler()}"
        expected.add((n * 10, n))
        docs[n * 10 + 1] = f"{filler()} {' '.join(body[5:19])} {filler()}"  # too short a quotation
        docs[n * 10 + 2] = " ".join(instruction) + " " + filler()
        missing = [w for i, w in enumerate(body[:40]) if i % 12 != 7]
        docs[n * 10 + 3] = " ".join(missing)
        expected.add((n * 10 + 3, n))
    docs |= {900: None, 901: "", 902: "😀 " * 1000}
    made = spark.createDataFrame([(k, v, "c") for k, v in docs.items()], "doc_id long, text string, item_id string")
    tests = spark.createDataFrame([(k, " ".join(v)) for k, v in items.items()] + [(77, None)], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in leakage.find_leaks(made, tests).collect()} == expected
    assert leakage.find_leaks(made, tests.limit(0)).count() == 0 and leakage.find_leaks(made.limit(0), tests).count() == 0


def test_shards_of_items_add_up(spark, monkeypatch):
    items = spark.createDataFrame([(n, " ".join(f"i{n}w{k}" for k in range(40))) for n in range(5)], "item_id long, text string")
    docs = items.select(F.col("item_id").alias("doc_id"), "text")
    monkeypatch.setattr(leakage, "SHARD_WORDS", 50)
    assert len(leakage.item_shards(items, "item_id", "text")) == 5
    assert {(r["doc_id"], r["item_id"]) for r in leakage.find_leaks(docs, items).collect()} == {(n, n) for n in range(5)}


def test_chance_anchors_do_not_hide_a_passage(spark):
    rng = random.Random(9)
    passage = [f"p{n}" for n in range(25)]
    quoted = [w if n != 12 else "typo" for n, w in enumerate(passage)]
    chance = [f"c{n}" for n in range(4)]
    for many in (0, 63, 64, 200):  # four words of the document that the item holds many times after the passage
        item = passage + [w for n in range(many) for w in (*chance, f"u{n}")]
        text = quoted[:13] + chance + quoted[13:] if many % 2 else chance + quoted
        items = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
        docs = spark.createDataFrame([(7, " ".join(text + [rng.choice("xyz") for _ in range(9)]))], "doc_id long, text string")
        assert leakage.find_leaks(docs, items).count() == 1, many


def test_every_passage_at_the_limits_is_found():
    rng = random.Random(10)
    finder = leakage.LeakFinder([(1, [f"p{n}" for n in range(60)])])
    for _ in range(300):
        start = rng.randrange(40)
        passage = [f"p{n}" for n in range(start, start + 20)]
        for at in rng.sample(range(2, 18), 4):  # the ends stay, so that the passage has twenty words
            passage[at] = f"x{rng.randrange(99)}"
        assert finder.leaks([f"q{n}" for n in range(9)] + passage + [f"r{n}" for n in range(9)])
    assert not finder.leaks([f"p{n}" for n in range(10, 29)] + ["q"] * 9)


def test_near_copies_among_the_items_keep_what_they_share(spark):
    instruction = "please read the extract and answer the question below now".split()
    body = [f"b{n}" for n in range(60)]
    near = {n: instruction + [w if at != 9 * n else "typo" for at, w in enumerate(body)] for n in range(4)}
    others = {10 + n: instruction + [f"o{n}w{at}" for at in range(50)] for n in range(3)}
    items = spark.createDataFrame([(k, " ".join(v)) for k, v in (near | others).items()], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(body[20:50])), (2, " ".join(instruction))], "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in leakage.find_leaks(docs, items).collect()} == {(1, n) for n in range(4)}


def test_words_are_located():
    for text in ("one two <b>three</b> four", "caf&eacute;s &amp; co. x&#178; [12] soft\u00adly ﬁn STRASSE ßa e\u0301t a<b &lt;i&gt; AT&T;", "", "😀 a_b 5 € &nbsp;z &unknown; &"):
        found = leakage.located(text)
        assert [w for a, b in found for w in words(text[a:b])] == words(text), text


def test_removal(spark):
    items = spark.createDataFrame([(1, " ".join(f"w{n}" for n in range(30)))], "item_id long, text string")
    leak = " ".join(f"w{n}" for n in range(3, 28))
    docs = spark.createDataFrame([(1, "Before &amp; it, " + leak.upper() + ". After it all." + " filler" * 30), (2, leak), (3, "nothing"), (4, None)], "doc_id long, text string")
    found = {r["doc_id"]: (r["text"], r["n_removed"]) for r in leakage.removed(docs, items).collect()}
    assert found == {1: ("Before &amp; it, . After it all." + " filler" * 30, 25), 2: (None, 25)}


def test_removal_of_spans():
    assert leakage.remove_spans("one two <b>three</b> four", [(1, 3)], 0.9) == "one </b> four"
    assert leakage.remove_spans("one two", [(0, 2)], 0.5) is None


# ---------------------------------------------------------------- p8
def test_mix_reaches_its_shares(spark):
    texts = [(n, "hot ", " ".join(["tok"] * (n % 7 + 1))) for n in range(300)] + [(1000 + n, "Small", "tok tok tok") for n in range(5)] + [(2000, None, "tok"), (2001, "hot", None), (2002, "other", "tok")]
    docs = spark.createDataFrame(texts, "doc_id long, source string, text string")
    targets = spark.createDataFrame([("Hot", 0.75, 1), ("small", 0.2, 4), ("none", 0.05, 2)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(docs, targets)
    rows = mixed.collect()
    used = Counter()
    for r in rows:
        used[r["source"]] += r["tokens_used"]
        assert r["tokens_used"] <= r["repeats"] * r["n_tokens"]
    assert max(r["repeats"] for r in rows if r["source"] == "small") == 4 and max(r["repeats"] for r in rows if r["source"] == "hot") == 1
    assert abs(used["hot"] / used["small"] - 0.75 / 0.2) < 0.1
    shares = {r["source"]: r for r in mixing.shares(mixed, targets).collect()}
    assert shares["none"]["reached_share"] == 0 and abs(sum(r["reached_share"] for r in shares.values()) - 1) < 1e-5
    again = {tuple(r) for r in mixing.mix(docs.repartition(9), targets).collect()}
    assert again == {tuple(r) for r in rows}
    assert mixing.mix(docs.limit(0), targets).count() == 0


# ---------------------------------------------------------------- p9
RIGHT = {
    "fr": "L’été, la thèse décrivit l’œuvre à ses frais : « Ça va ? » 12 €",
    "de": "Die Größe überzeugte während der Prüfung – „schön“ für 5 £",
    "pl": "Żona wyjaśniła powieść, książka i źródło w końcu łąka",
    "ru": "Палата изучила решение без причины, а суд закончил",
}


@pytest.mark.parametrize("page", ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251"])
@pytest.mark.parametrize("lang", RIGHT)
def test_restores_what_was_misread(page, lang):
    right = RIGHT[lang]
    raw = right.encode("utf-8")
    back = {b: c for c, b in encoding._byte_map(page).items()}
    garbled = "".join(chr(b) if b < 0x80 else back[b] for b in raw)
    found = encoding.repair("Before it. " + garbled)
    assert found and found["restored"] == "Before it. " + right


SCRIPTS = {
    "tr": "Şehirdeki çocuğun ağır yükü, İstanbul’da ışık", "signs": "good 😀 day ☺ and ✓ done ½ x₂", "zh": "法院认为该申请没有理由，因此予以驳回。", "ja": "裁判所は、この申立てには理由がないとした。", "ko": "법원은 이 신청에 이유가 없다고 보았다.",
    "he": "בית המשפט דחה את הבקשה ביום שני", "ar": "رفضت المحكمة الطلب يوم الاثنين", "hi": "न्यायालय ने सोमवार को आवेदन खारिज किया", "th": "ศาลยกคำร้องเมื่อวันจันทร์", "el": "Το δικαστήριο απέρριψε την αίτηση",
    "vi": "Tòa án đã bác đơn khởi kiện vào thứ hai", "hy": "Դատարանը մերժեց դիմումը երկուշաբթի", "ka": "სასამართლომ უარყო განცხადება ორშაბათს", "uk": "Суд відхилив заяву у понеділок через її ґрунт", "cs": "Příliš žluťoučký kůň úpěl ďábelské ódy",
}


@pytest.mark.parametrize("script", SCRIPTS)
@pytest.mark.parametrize("times", [1, 2, 7])
def test_any_script_and_any_number_of_readings(script, times):
    right = "Note: " + SCRIPTS[script]
    assert encoding.repair(right) is None
    for page in ("cp1252", "latin-1", "mac_roman", "cp437", "cp1251"):
        back = {b: c for c, b in encoding._byte_map(page).items()}
        garbled = right
        for _ in range(times):
            garbled = "".join(chr(b) if b < 0x80 else back[b] for b in garbled.encode())
        found = encoding.repair(garbled)
        assert found and (found["restored"] == right or found["lossy"]), page


def test_single_byte_readings():
    for right, true in (("Το δικαστήριο απέρριψε την αίτηση του", "cp1253"), ("Şehirdeki çocuğun ağır yükü ve ışığı", "cp1254"), ("Палата изучила решение без причины", "cp1251")):
        assert encoding.repair(right.encode(true).decode("cp1252", "replace"))["restored"] == right


def test_chance_neighbours_and_single_marks():
    for right in ("café…” and olé…”", "“CAFÉ”, “PÂTÉ”", "irmã…” foi", "Это её «дом» — её, и СССР» ещё", "Þingvellir og Ðorvik, það er ýsa í ánni"):
        assert encoding.repair(right) is None
    long = "так сказал он в этом длинном тексте, который верен"
    assert encoding.repair("вЂ” " + long)["restored"] == "— " + long


def test_twice_misread_escaped_and_lost():
    right = RIGHT["fr"]
    twice = right
    for _ in range(2):
        twice = "".join(chr(b) if b < 0x80 else {v: k for k, v in encoding._byte_map("cp1252").items()}[b] for b in twice.encode())
    assert encoding.repair(twice)["restored"] == right
    assert encoding.repair("caf&#195;&#169; ol&eacute;")["restored"] == "café olé"
    lost = encoding.repair("The caf� cost 5")
    assert lost["lossy"] and lost["restored"] is None


@pytest.mark.parametrize("text", [*RIGHT.values(), None, "", "plain", "PÂTÉ, CRÊPE, ÂGE : “CAFÉ”", "√2 ≈ 1.41, ∂x, Ω and µ", "Caf&eacute; cr&egrave;me &amp; th&eacute;, 12&nbsp;&euro; &#8211;", "Was it lost???? N?A", "Ðorvik, Þorlak, 5 m³ and │ ═ │", "СССР» и «Рига»"])
def test_right_text_stays(text):
    assert encoding.repair(text) is None


def test_repair_documents(spark):
    rows = spark.createDataFrame([(1, "cafÃ©", "x"), (2, "café", "x"), (3, None, "x"), (None, "cafÃ©", "x"), (4, "Ã© " * 20_000, "x")], "doc_id long, text string, restored string")
    found = {r["doc_id"]: r["restored"] for r in encoding.repair_documents(rows).collect()}
    assert found.keys() == {1, 4} and found[1] == "café" and found[4] == "é " * 20_000


# ---------------------------------------------------------------- queries
def test_queries_run(spark, folder):
    from umbra.llm.queries import QUERIES

    for name in ("p1_agreement", "p2_redacted", "p4_rebuilt", "p7_removed", "p6_counts", "p7_leaks", "p8_mix", "p9_restored", "p4_pieces"):
        assert QUERIES[name](spark, folder).count() >= 0


def test_splitting_sql(spark, folder):
    import duckdb

    from umbra.llm.queries import QUERIES, SQL

    connection = duckdb.connect()
    for name in ("chunk", "chunk_profile"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    for name in ("p4_found", "p4_rebuilt"):
        expected = set(connection.execute(SQL[name]).fetchall())
        assert {tuple(r) for r in QUERIES[name](spark, folder).collect()} == expected and expected


def test_no_openings_that_meet_the_threshold_are_left_apart(spark, monkeypatch):
    rng, made = random.Random(5), set()
    cores = ["this is something that nobody in our office may ever discuss", "my cousin built a small boat out of bottles for the race", "ab", "abc", "\U0001d400\U0001d401 xyz"]
    spare = "this that never office cousin built boat small large".split()
    while len(made) < 300:
        said = rng.choice(cores).split()
        for _ in range(rng.randrange(4)):
            said[rng.randrange(len(said))] = rng.choice(spare) + rng.choice(["", "s", "x"])
        made.add(" ".join(said)[: rng.choice([3, 4, 5, 80, 80, 80, 80])].strip())
    made = sorted(made)
    root = list(range(len(made)))  # of all pairs, each looked at

    def least(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(made)):
        for b in range(a):
            if pairs.similarity(made[a], made[b]) >= pairs.SIMILARITY:
                x, y = sorted((least(a), least(b)))
                root[y] = x
    expected = {n: least(n) for n in range(len(made))}
    openings = spark.createDataFrame([(n, text, 1 + n % 7) for n, text in enumerate(made)], "id long, opening string, n_prompts long")
    for shard in (40_000, 90):
        monkeypatch.setattr(pairs, "SHARD", shard)
        links = pairs.opening_links(openings).collect()
        assert all(pairs.similarity(made[r["id"]], made[r["head"]]) >= pairs.SIMILARITY for r in links)
        joined = pairs.components(spark.createDataFrame([tuple(r) for r in links], "id long, head long"), "id", "head").collect()
        assert expected == {n: n for n in range(len(made))} | {r["node"]: r["component"] for r in joined}


def test_texts_are_not_sent_once_for_each_shard(spark, monkeypatch):
    rng, made = random.Random(8), []
    for n in range(60):
        said = [f"w{rng.randrange(400)}" for _ in range(12)]
        made.append((f"t{n}", "train", "s", " ".join(said), DAY))
        if n % 2:
            said[rng.randrange(12)] = "other"
            made.append((f"e{n}", "test", "s", " ".join(said), DAY))
    folded = overlap.folded_records(spark.createDataFrame(made, "uid string, split string, source string, text string, loaded_at timestamp"))
    digest = {r["uid"]: r["digest"] for r in folded.collect()}
    expected = {(digest[f"t{n}"], digest[f"e{n}"]) for n in range(1, 60, 2)}
    for shard, block in ((1_500_000, 4_000_000), (60, 100)):
        monkeypatch.setattr(overlap, "SHARD_WORDS", shard)
        monkeypatch.setattr(overlap, "BLOCK_WORDS", block, raising=False)
        found = overlap.class_pairs(folded)
        assert {(r["train_digest"], r["eval_digest"]) for r in found.collect()} == expected
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Generate" not in plan  # what is spread over the shards lies on no disk
