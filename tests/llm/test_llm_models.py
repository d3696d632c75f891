"""Quality network, toxicity grammar, personal data and decontamination."""

import os
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from acervo.llm import decontaminate, pii, quality, toxicity
from acervo.llm.common import table

SF_DIR = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")
ROWS = [(1, "plain words here"), (2, None), (3, ""), (4, "!! ## " * 40_000), (1, "plain words here"), (None, "no id"), (5, " \n\t")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(d, t, 1, "s", 2.0) for d, t in ROWS], "doc_id long, text string, quality int, toxic string, score double")


@pytest.fixture(scope="module")
def few_labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 1), (4, None, None), (None, 1, 1), (77, 0, 1)], "doc_id long, quality int, toxic int")


# --- quality ---------------------------------------------------------------------------

def test_gradient_equals_differences():
    rng = np.random.default_rng(1)
    net = quality.Network(rng.normal(0, 1, (256, quality.EMBED)), rng.normal(0, 1, (quality.WIDTH, quality.EMBED, quality.FILTERS)), rng.normal(0, 1, quality.FILTERS),
                          rng.normal(0, 1, (2, quality.FILTERS + 1)), np.array([0.1]))
    net.embed[0] = 0
    texts, wanted = [b"abc " * 200, b"zzz!", b"\xc3\xa9t\xc3\xa9 " * 90], np.array([1.0, 0.0, 1.0])

    def loss():
        tables64 = np.einsum("be,wef->wbf", net.embed, net.kernel)
        p = np.clip(quality.probability(net, tables64, texts), 1e-12, 1 - 1e-12)
        return -np.mean(wanted * np.log(p) + (1 - wanted) * np.log(1 - p))

    slopes = quality.gradient(net, np.einsum("be,wef->wbf", net.embed, net.kernel), texts, wanted)
    for part, slope in zip((net.embed, net.kernel, net.bias, net.combine, net.offset), slopes, strict=True):
        at = np.unravel_index(np.abs(slope).argmax(), slope.shape)
        kept, eps = part[at], 1e-5
        part[at] = kept + eps
        up = loss()
        part[at] = kept - eps
        down = loss()
        part[at] = kept
        assert abs((up - down) / (2 * eps) - slope[at]) < 1e-4 + 0.02 * abs(slope[at])


def test_score_depends_on_all_bytes_and_on_nothing_else():
    rng = np.random.default_rng(2)
    net = quality.fit([b"good words " * 30, b"%%% $$$ ### " * 30] * 20, [1, 0] * 20, epochs=8)
    tables32 = net.tables()
    clean = b"good words " * 3000
    alone = quality.probability(net, tables32, [clean])
    batch = quality.probability(net, tables32, [b"", clean, b"%%% $$$ ### " * 50, clean + b"%%% $$$ ### " * 3000, bytes(rng.integers(32, 127, 300, dtype=np.uint8))])
    assert abs(alone[0] - batch[1]) < 1e-6 and batch[1] > 0.5 > batch[2] and batch[3] < batch[1]
    assert 0 <= batch[0] <= 1


def test_repetition_counts_runs_seen_before():
    texts = [b"ab" * 128, bytes(range(1, 256)) + b"\x00" * 0, b"abc"]
    data, hops = quality.laid_out(texts)
    share = quality.repetition(data, texts, hops)
    starts = np.cumsum(hops) - hops
    assert share[starts[0]] > 0.98 and share[starts[1]] == 0 and share[starts[2]] == 0


@tables
def test_quality_on_held_out_rows(spark):
    docs, labels = table(spark, SF_DIR, "documents"), table(spark, SF_DIR, "labels")
    got = quality.classified(docs, labels).join(labels, "doc_id").where("held_out").select("quality", "predicted").collect()
    assert all((r["quality"], r["predicted"]) != (1, 0) for r in got)
    assert sum(r["quality"] == r["predicted"] for r in got) / len(got) > 0.95


def test_quality_odd_rows(odd, few_labels, spark):
    got = quality.classified(odd, few_labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["held_out"] for r in got if r["doc_id"] == 1} == {zlib.crc32(b"1") % 3 == 1}
    assert {r["held_out"] for r in got if r["doc_id"] is None} == {False}
    assert quality.classified(odd.limit(0), few_labels).count() == 0
    assert quality.classified(odd, few_labels.limit(0)).count() == len(ROWS)
    assert quality.accepted(odd, few_labels).columns == odd.columns


# --- toxicity --------------------------------------------------------------------------

def test_clauses_not_words():
    g = toxicity.Grammar()
    weight = lambda text: sum(w for _, w in toxicity.matched_clauses(g, text))
    plain, aimed, denied, told = map(weight, ("the idiot came", "you are an idiot", "you are not an idiot", "she said you are an idiot"))
    assert aimed > plain > denied > 0 and told < aimed
    assert weight("we kill the lights") == 0 < weight("i will kill you") and weight("you will die") > 0
    assert weight("not here. you idiot") > weight("you are not an idiot")
    assert weight("a fine day") == 0
    assert toxicity.matched_clauses(g, "Nice. You idiot! Bye.")[0][0] == "you idiot"


def test_every_matched_clause_is_scored():
    g = toxicity.Grammar()
    for text in ("you 'idiot'", "@idiot you", "\u00a1idiota!", "idiot\u00a0!", "you\u00a0idiot\u00a0here", "\u2018idiot\u2019", "idiot\U0001f600", "\u00abidiot\u00bb", "-idiot- you", "idiot_you", "the moron\u2026"):
        assert toxicity.matched_clauses(g, text) and toxicity.summary(g, g.triggers(), text)[1] > 0, text
    assert toxicity.summary(g, g.triggers(), "a fine 'day'") == (0.0, 0.0, 0.0, 0.0)


def test_weights_are_learned():
    rng = random.Random(3)
    texts = [" ".join(rng.choices("red blue green tall".split(), k=8)) + (" grubnak" if i % 2 else "") for i in range(80)]
    g = toxicity.learned(texts, [i % 2 for i in range(80)])
    p = toxicity.probability(g, g.triggers(), ["red blue grubnak", "red blue", "", "“grubnak”"])
    assert p[0] > 0.5 > p[1] and p[2] < 0.5 and p[3] > 0.5


@tables
def test_toxicity_on_held_out_rows(spark):
    docs, labels = table(spark, SF_DIR, "documents"), table(spark, SF_DIR, "labels")
    got = toxicity.toxic(docs, labels).join(labels, "doc_id").where("held_out").select("toxic", "predicted").collect()
    assert sum(r["toxic"] == 0 and r["predicted"] == 1 for r in got) <= 0.03 * len(got)
    assert sum(r["predicted"] for r in got if r["toxic"]) >= 0.6 * sum(r["toxic"] for r in got)  # some labels here are noise


def test_toxicity_odd_rows(odd, few_labels):
    few = few_labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    docs = odd.drop("toxic").withColumn("held_out", F.lit(1))
    got = toxicity.toxic(docs, few).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (2, 3)}) == 1
    assert toxicity.toxic(docs.limit(0), few).count() == 0


# --- personal data ---------------------------------------------------------------------

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(d):
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False,
                    "card": 13 <= len(d) <= 19 and plain_luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if good:
                out.append((kind, *m.span()))
    return out


def test_base_spans_equal_the_patterns():
    rng = random.Random(6)
    bits = ["a@b.co", "@", ".", "-", "+", "1", "255", "256", "4111 1111 1111 1111", "x_y%z", " ", "(", ")", "é", "😀", "+49 30 1234567", "10.0.0.1", "00012.1.1.1", "1.1.1.00000000000000000000000999", "com", "_", "\n", "5500-0000-0000-0004", "٣"]
    for _ in range(4000):
        text = "".join(rng.choices(bits, k=rng.randint(0, 14)))
        assert pii.base_spans(text) == brute_spans(text), text
    for text in ("a" * 300_000, "1" * 200_000, "1." * 100_000, "+1" * 100_000, "@" * 200_000, "a." * 100_000 + "@b"):
        assert pii.joined(pii.base_spans(text)) is not None


def test_boosted_spans_are_added_beside_the_base(spark):
    rng = random.Random(8)
    number = lambda: f"({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
    rows = [(i, f"some words +1 {number()} more words") for i in range(200)] + [(500 + i, f"order {rng.randrange(10**7, 10**9)} shipped") for i in range(200)]
    rows += [(900, "please call (415) 555-2671 today"), (901, "order 12345678 shipped"), (902, None), (903, ""), (None, "a@b.co"), (904, "a@b.co"), (904, "a@b.co"), (905, "x " * 200_000 + "a@b.co")]
    df = spark.createDataFrame([(*r, "b", "s", 0) for r in rows], "doc_id long, text string, base string, spans string, n_chars long")
    got = {r["doc_id"]: r for r in pii.found(df).collect()}
    assert got[900]["spans"] == "phone:12:26" and got[900]["n_phone"] == 0
    assert got[901]["spans"] == "" == got[902]["spans"] == got[903]["spans"]
    assert got[0]["n_phone"] == 1 and got[0]["spans"].startswith("phone:11:")
    assert got[905]["spans"] == "email:400000:400006" and got[904]["n_email"] == 1
    clean = {r["doc_id"]: r for r in pii.redacted(df).collect()}
    assert clean[900]["text"] == "please call [PHONE] today" and clean[900]["n_chars"] == 25
    assert clean[902]["text"] is None and clean[903]["text"] == "" and clean[904]["text"] == "[EMAIL]"
    assert pii.redacted(df).columns == df.columns
    assert pii.found(df.limit(0)).count() == 0


def test_candidates_end_at_every_group():
    cut = lambda text: {text[s:e] for s, e in pii.candidates(text)}
    assert {"1 (826) 555-4081", "(826) 555-4081", "190.137.223.204"} <= cut("+1 (826) 555-4081 190.137.223.204")
    assert "4111 1111 1111 1111" in cut("4111 1111 1111 1111 2024-01-02")
    assert {"555-123-4567", "555-987-6543"} <= cut("555-123-4567 555-987-6543")
    assert "(415) 555-2671" in cut("10 20 30 40 50 (415) 555-2671 7")
    assert len(pii.candidates("1 " * 5000)) <= 13 * 5000


def test_a_number_before_others_is_found():
    rng = random.Random(5)
    number = lambda: f"({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
    texts = [f"call me on +1 {number()} or +44 {number()} soon" if i % 2 else f"built on {rng.randint(10, 30)}/{rng.randint(10, 12)}/{rng.randint(1900, 2024)} as part {rng.randint(10**6, 10**8)} there" for i in range(600)]
    models = pii.fit(texts)
    text = "call +1 (826) 555-4081 190.137.223.204 now"
    base = pii.base_spans(text)
    assert [k for k, _, _ in base] == ["ip"]
    assert pii.redact(text, base + pii.added_spans(models, text, base)) == "call [PHONE] [IP] now"


def test_spelled_out_addresses_are_found():
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(4, 9)))
    ends = "", ".mail"
    texts = [f"please write to {word()}{rng.choice(ends)}@{word()}{rng.choice(ends)}.com or call +1 {rng.randint(2 * 10**9, 9 * 10**9)} now" for _ in range(300)]
    models = pii.fit([*texts, *(f"item {rng.randint(10**7, 10**8)} sold" for _ in range(100))])
    found = lambda text: [text[s:e] for k, s, e in pii.added_spans(models, text, pii.base_spans(text)) if k == "email"]
    for own in ("john at example dot com", "john[at]example.com", "jo.hn [at] mail [dot] example [dot] com"):
        assert found(f"please write to {own} now") == [own]
    assert found("please look at example.com now") == []


def test_lowest_precise_cut_over_all_cuts(monkeypatch):
    scores = np.array([0.99] + [0.9 - i / 10_000 for i in range(400)] + [0.1] * 100)
    wanted = [None] + ["phone"] * 400 + [None] * 100
    rows = [x for s, k in zip(scores, wanted, strict=True) for x in (([s], k), ([s], k), ([s], k))]
    monkeypatch.setattr(pii, "examples", lambda texts: rows)
    monkeypatch.setattr(pii, "boosted", lambda x, y: pii.Trees(0.0, []))
    monkeypatch.setattr(pii.Trees, "score", lambda self, x: x[:, 0])
    assert abs(pii.fit([])["phone"].threshold - scores[400]) < 1e-6


def test_redaction_of_overlaps():
    assert pii.redact("ab cd ef", [("card", 0, 5), ("phone", 3, 8)]) == "[CARD]"
    assert pii.redact("ab cd ef", [("ip", 0, 2), ("phone", 6, 8)]) == "[IP] cd [PHONE]"


# --- decontamination -------------------------------------------------------------------

ITEM = "A train leaves the old station with Alice at 60 km per hour and meets Bob after 3 hours on the way to the coast."


def test_templates(spark):
    items = [(1, ITEM), (2, None), (3, ""), (4, "too short"), (5, "what is the capital of the northern province"), (None, ITEM), (1, ITEM)]
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    other = ITEM.replace("Alice", "Carol").replace("60", "85").replace("Bob", "Dave").replace("3 hours", "7 hours")
    mixed_up = "A train leaves the old station with Carol at 60 km per hour and then Alice asks and Carol meets"
    rows = [(1, f"Some text first. {ITEM} And more."), (2, f"Intro words. {other} Outro."), (3, "The train was late and nobody at the station knew why it had to wait."),
            (4, None), (5, ""), (6, "noise " * 30_000 + ITEM.lower() + " noise" * 10), (1, ITEM), (None, ITEM), (7, "so what is the capital of the northern province then"), (8, mixed_up)]
    docs = spark.createDataFrame([(*r, 9, "z") for r in rows], "doc_id long, text string, item_id long, share string")
    got = decontaminate.contaminated(docs, bench).collect()
    assert sorted((r["doc_id"] or 0, r["item_id"]) for r in got) == [(0, 1), (1, 1), (1, 1), (2, 1), (6, 1), (7, 5)]
    assert next(r for r in got if r["doc_id"] == 2)["changed_slots"] >= 4
    left = decontaminate.decontaminated(docs, bench)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [3, 4, 5, 8]
    small = decontaminate.contaminated(docs, bench, block_bytes=40).collect()
    assert sorted(map(str, small)) == sorted(map(str, got))
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_slots_must_agree():
    item, doc = b"take 5 apples and 5 pears".split(), b"take 7 apples and 9 pears".split()
    assert decontaminate.slots(item, doc, [(i, i) for i in range(6)]) == (2, 1, 2)


def leaked(item, *docs):
    return [bool(x) for x in decontaminate.find(decontaminate.Items([(1, item)]), decontaminate.Vocabulary(), list(docs))]


def test_every_instance_of_a_form_is_judged():
    item = "if Anna has 3 apples and Anna buys 3 more then how many apples does Anna have"
    wrong = "if Bob has 5 apples and Carl buys 8 more then how many apples does Dave have"
    right = "if Eve has 6 apples and Eve buys 6 more then how many apples does Eve have"
    far = " something else is told here for a while and then it goes on. "
    assert leaked(item, wrong, wrong + far + item, wrong + far + right, wrong + far + wrong) == [False, True, True, False]


def test_short_items_are_found_after_headings_and_in_mid_line():
    for item in ("What is the capital of France?", "Who wrote the play Hamlet", "Which planet is closest to the Sun now?"):
        docs = f"Quiz\n{item}\nnext", f"Quiz {item} next", f"Some words before, then {item}", f"some words. {item}", item.lower(), item.replace(" ", "\n")
        assert leaked(item, *docs) == [True] * len(docs), item
    moved = "Which planet is closest to the Moon now?"
    assert leaked("Which planet is closest to the Sun now?", f"Quiz\n{moved}", "quiz. another planet is found near the sun") == [True, False]
    assert leaked("one day we went to see the house of Peter by the sea", "then one day we went to see the house of\nCarla by the sea") == [True]


def test_dense_numbers_and_names_are_found_verbatim():
    items = "A) 12 km B) 15 km C) 18 km D) 20 km", "1, 1, 2, 3, 5, 8, 13, 21, 34, 55", "Anna Bob Carl Dora Emil Fred Gina Hans Ida", "1914 1918 1939 1945", "10 20 30 40 50 60"
    for item in items:
        assert leaked(item, f"some words and {item} then more", f"Head\n{item}") == [True, True], item
    assert leaked(items[0], "A) 13 km B) 16 km C) 19 km D) 21 km") == [False] == leaked(items[3], "years 1914 1918 1939 1946 here")


@tables
def test_every_embedded_item_is_found(spark):
    docs = table(spark, SF_DIR, "documents").select("doc_id", "text").collect()
    bench = table(spark, SF_DIR, "benchmark").collect()
    want = {(d["doc_id"], b["item_id"]) for d in docs for b in bench if b["text"] in (d["text"] or "")}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(table(spark, SF_DIR, "documents"), table(spark, SF_DIR, "benchmark")).collect()}
    assert want and got == want


def test_long_runs_of_marks_take_linear_time():
    started = time.time()
    assert decontaminate.canonical("a" + "-" * 1_000_000 + "b", True)[1] == "a" + "-" * 1_000_000 + "b"
    assert decontaminate.canonical("(" * 500_000 + "Kilo" + "." * 500_000, False) == (decontaminate.NAMED, "kilo")
    assert decontaminate.canonical("+" * 500_000, False)[1] == ""
    assert time.time() - started < 5
