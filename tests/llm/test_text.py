"""p5 to p9 on small fixtures against plain Python."""

import random
from datetime import datetime, timedelta

import pytest
from oracle import duck, spark_rows
from pyspark.sql import functions as F

from sediment.llm import conversations as C
from sediment.llm import mixing, packing, pii, truncation
from sediment.llm import registry
from sediment.llm.tokens import counted

T0 = datetime(2025, 1, 1)
NOTE = "id long, session_id long, role string, content string, timestamp timestamp, at string, position int, _seg int"


def notes(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], NOTE)


def at(n):
    return T0 + timedelta(seconds=n)


@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p5_found"])
def test_query_equals_sql(spark, small, name):
    assert spark_rows(registry.queries()[name](spark, small)) == duck(small, registry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - {"p1_found", "p2_found", "p5_found"}))
def test_query_runs(spark, small, name):
    registry.queries()[name](spark, small).collect()


def kept(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.session_id, r.position)):
        out.setdefault(r.session_id, []).append(r.note_id)
    return out


def test_conversations(spark):
    rows = [
        (1, 1, "system", "s", at(0)), (3, 1, " User", "q", at(1)), (4, 1, "AI", "a", at(2)), (5, 1, "ai", "a", at(2)), (6, 1, "tool", "t", at(3)), (7, 1, "agent", "b", at(4)), (4, 1, "AI", "a", at(2)),
        (10, 2, "user", "q", at(1)), (11, 2, "user", "again", at(2)), (12, 2, "assistant", "a", at(3)),
        (20, 3, "user", "q", at(1)), (21, 3, "assistant", "​ \t", at(2)),
        (30, 4, "assistant", "a", at(1)),
        (40, 5, "user", "q", None), (41, 5, "assistant", "a", at(1)),
        (50, 6, "user", None, at(0)), (51, 6, "assistant", "a", at(1)),
        (60, 7, "narrator", "x", at(0)), (61, 7, "user", "q", at(1)), (62, 7, "assistant", "a", at(2)),
        (70, None, "user", "q", at(0)),
        (80, 8, "user", "q" * 200_000, at(5)), (79, 8, "assistant", "a", at(5)),
        (90, 9, "user", "q", at(5)), (91, 9, "assistant", "a", at(5)), (92, 9, None, None, None),
    ]
    assert kept(C.conversations(notes(spark, rows), 0)) == {1: [1, 3, 4, 6, 7]}


def test_clock_offsets_mend_a_slow_sender(spark):
    rows = [(1, 1, "user", "q", at(100)), (2, 1, "assistant", "a", at(70)), (3, 1, "user", "r", at(200)), (4, 1, "assistant", "b", at(170))]
    assert kept(C.conversations(notes(spark, rows), 0)) == {}
    mended = C.conversations(notes(spark, rows), 60_000)
    assert kept(mended) == {1: [1, 2, 3, 4]} and {r.offset_ms for r in mended.collect()} == {0, 30_000}
    assert kept(C.conversations(notes(spark, rows), 10_000)) == {}


def test_no_notes(spark):
    assert C.conversations(notes(spark, []), 0).count() == 0


NAMES = pii.name_rules(["Ada Lovering", "Zoë Grünberg"])
CASES = [
    ("write to a.b+c@mail.example.org now", "write to [EMAIL] now"), ("mail ada [at] x.example", "mail [EMAIL]"), ("ada (at) x (dot) example;", "[EMAIL];"), ("x＠y.example", "[EMAIL]"),
    ("call +44 7700 900123", "call [PHONE]"), ("(312) 555-0143 is mine", "[PHONE] is mine"), ("ring five five five zero one zero two", "ring [PHONE]"), ("to tel:+1-312-555-0143;ext=4.", "to [PHONE]."),
    ("SSN 912 34 5678.", "[ID]."), ("verify 912-34-5678 first", "verify [ID] first"), ("paspor ZZ 290 0295", "[ID]"), ("NIK 0051490283231332", "[ID]"), ("QQ 72 86 29 D", "[ID]"),
    ("at Flat 6A, 50 Cooper's Rd., Marrowfield today", "at [ADDRESS] today"), ("Jl. Kenanga 190, RT 02/RW 03.", "[ADDRESS]."), ("9 old mill lane, apt 4", "[ADDRESS]"),
    ("As Ada Lovering put it", "As [NAME] put it"), ("LOVERING, ADA", "[NAME]"), ("Z. Grunberg and Bu Ada", "[NAME] and [NAME]"), ("Mr Unknownsson said", "[NAME] said"),
    ("JOHN.DOE [AT] EXAMPLE [DOT] COM", "[EMAIL]"), ("call ＋４４ now or +４４ ７７００ ９００１２３", "call ＋４４ now or [PHONE]"), ("I met with Sarah Connor today", "I met with [NAME] today"),
    ("call 312-555-0143 S. Lovering", "call [PHONE] [NAME]"), ("IBAN GB82 WEST 1234 5698 7654 32", "IBAN [BANK_ACCOUNT]"), ("card 4111 1111 1111 1111", "card [CARD]"),
]
CLEAN = [
    "Shard 705-47-5816 was moved", "Timeout set to 843.203.6393 ticks", "Checksum 1850640095 matched", "Span 0064139147674039 closed late.", "build 356-200-51", "Pinned @core/lib@40.7.18 in the file",
    "Row 3 Column 13 of the Maple Street dataset", "Lane 54 of the Quiet Harvest pipeline", "Handle @archiver is the bot", "Version 2025.22.9 follows 2025.44.38.", "The probe answered from 10.0.58.33:8610", "",
    "IBAN GB82 WEST 1234 5698 7654 33", "Meeting room Tall Cedar is booked", "ada.lovering", "Dated 2025-03-16 40:48:27, seq 724-14-7830.",
]


@pytest.mark.parametrize("text,want", CASES)
def test_found(text, want):
    assert pii.redact(text, NAMES)[0] == want


@pytest.mark.parametrize("text", CLEAN)
def test_left_alone(text):
    assert pii.redact(text, NAMES) == (text, [])


def test_name_in_address_only_is_no_name():
    assert pii.redact("ada.lovering@x.example", NAMES) == ("[EMAIL]", ["email"])


def test_validators():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97_iban("GB82WEST12345698765432") and pii.mod97_national("85073003328")


def test_long_texts_take_linear_time():
    for text in ("a" * 300_000, "1 " * 100_000, "Ada " * 60_000, "x@" * 100_000, " " * 300_000, "12-" * 100_000):
        pii.redact(text, NAMES)


def test_many_names_cost_no_more_and_nothing_is_missed():
    people = [f"Given{chr(97 + i % 26)}{i} Family{i}" for i in range(5_000)]
    names = pii.name_rules(people)
    assert pii.redact("Givena0 Family4999 and G. Family77.", pii.name_rules([p.replace("0", "o").translate(str.maketrans("123456789", "abcdefghi")) for p in people]))[1] == []
    spelled = ["".join(c if not c.isdigit() else "abcdefghij"[int(c)] for c in p) for p in people]
    names = pii.name_rules(spelled)
    assert pii.redact(f"ask {spelled[17]} or {spelled[4_321].split()[1].upper()}, {spelled[5].split()[0]}!", names)[0] == "ask [NAME] or [NAME]!"


def test_redacted_column(spark):
    df = spark.createDataFrame([(1, None, "p"), (2, "", "p"), (3, "call +44 7700 900123", "p")], "id long, content string, pii string")
    got = {r.id: (r.pii.clean, r.pii.kinds) for r in pii.redacted(df, "content", []).collect()}
    assert got == {1: (None, []), 2: ("", []), 3: ("call [PHONE]", ["phone"])}


@pytest.mark.parametrize("seed", range(6))
def test_containers(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 50, 97])
    sizes = [rng.randint(1, capacity) for _ in range(rng.choice([0, 1, 40, 120]))]
    bins, _ = packing.complete(sizes, capacity)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= capacity for b in bins)
    assert -(-sum(sizes) // capacity) <= len(bins) <= len(packing.best_fit(sizes, capacity))


def test_completion_beats_best_fit():
    sizes, capacity = [6, 6, 5, 5, 5, 4, 4, 4, 3, 3, 3, 2] * 4, 10
    assert len(packing.complete(sizes, capacity)[0]) == -(-sum(sizes) // capacity)


@pytest.mark.parametrize("seed", range(8))
def test_proved_packings_are_the_best(seed):
    rng = random.Random(seed)
    capacity, sizes = 20, [rng.randint(3, 14) for _ in range(9)]

    def fewest(left, bins):
        if not left:
            return len(bins)
        out, seen = len(left) + len(bins), set()
        for k, room in enumerate(bins):
            if left[0] <= room and room not in seen:
                seen.add(room)
                out = min(out, fewest(left[1:], [*bins[:k], room - left[0], *bins[k + 1 :]]))
        return min(out, fewest(left[1:], [*bins, capacity - left[0]]))

    bins, proved = packing.complete(sizes, capacity)
    assert proved and len(bins) == fewest(sorted(sizes, reverse=True), []) >= packing.fewest(sizes, capacity)
    assert packing.fewest([11] * 5 + [9], 20) == 5 and packing.fewest([11] * 5 + [10] * 3, 20) == 7 and packing.fewest([], 20) == 0


def test_many_containers_are_searched_without_recursion():
    rng = random.Random(1)
    sizes = [rng.randint(26, 70) for _ in range(2500)]
    bins, _ = packing.complete(sizes, 100, nodes=3000)
    assert len(bins) > 900 and sorted(i for b in bins for i in b) == list(range(2500)) and len(bins) <= len(packing.best_fit(sizes, 100))


def test_too_many_capacities_or_targets_are_refused(spark, monkeypatch):
    monkeypatch.setattr(packing, "MOST_CAPACITIES", 1)
    monkeypatch.setattr(mixing, "MOST_TARGETS", 1)
    sizes = spark.createDataFrame([(1, 5)], "doc_id long, tokens long")
    with pytest.raises(ValueError):
        packing.packed_documents(sizes, spark.createDataFrame([("a", 9), ("b", 10)], "name string, token_limit int"))
    with pytest.raises(ValueError):
        mixing.wanted(spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats int"))


def test_packing_is_a_round_trip(spark):
    rng = random.Random(2)
    docs = [(i, rng.choice([0, 5, 40, 99, 100, 101, 250, 1000]), "x") for i in range(400)] + [(7, 3, "y"), (None, 9, "z"), (401, None, "z")]
    caps = spark.createDataFrame([("a", 100), ("b", 333), ("c", None), ("d", 0), (None, 5)], "name string, token_limit int")
    df = spark.createDataFrame(docs, "doc_id long, tokens long, size string")
    rows = packing.packed_documents(df, caps, group_containers=16).collect()
    tokens = {}
    for i, t, _ in docs:
        if i is not None and t:
            tokens[i] = max(t, tokens.get(i, 0))
    for name, cap in (("a", 100), ("b", 333)):
        mine = [r for r in rows if r.block_name == name]
        fill, parts = {}, {}
        for r in mine:
            fill[r.container] = fill.get(r.container, 0) + r.size
            parts.setdefault(r.doc_id, []).append((r.first_token, r.size))
        assert max(fill.values()) <= cap
        assert set(parts) == set(tokens)
        for i, p in parts.items():
            p.sort()
            assert len(p) == -(-tokens[i] // cap) and p[0][0] == 0 and all(a + s == b for (a, s), (b, _) in zip(p, p[1:])) and sum(p[-1]) == tokens[i]
        assert 1 - sum(tokens.values()) / (len(fill) * cap) < 0.05
    assert {r.block_name for r in rows} == {"a", "b"}
    assert packing.packed_documents(df.limit(0), caps).count() == 0


TARGETS = [("a ", 0.5, 2), ("B", 0.3, 3), ("none", 0.2, 4), (None, 0.1, 1)]


def test_mix_reaches_its_shares(spark):
    rng = random.Random(4)
    docs = [(i, "A" if i % 5 else " b", rng.randint(10, 400), f"k{i}", "clash") for i in range(2000)]
    docs += [(9000 + i, "a", 50, "same", "c") for i in range(300)] + [(1, None, 5, "q", "c"), (2, "other", 5, "r", "c"), (3, "a", 0, "s", "c"), (4, "a", None, "t", "c")]
    df = spark.createDataFrame(docs, "doc_id long, source string, tokens long, key string, copies string")
    mix, report = mixing.mixed(df, spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int"))
    got = {r.source: r for r in report.collect()}
    assert got["none"].tokens == 0
    assert got["a"].share == pytest.approx(0.625, abs=0.01) and got["b"].share == pytest.approx(0.375, abs=0.01)
    uses, keys = {}, {d[0]: d[3] for d in docs}
    for r in mix.collect():
        uses.setdefault(keys[r.doc_id], []).append(r["copy"])
    assert all(sorted(c) == list(range(1, len(c) + 1)) and len(c) <= 3 for c in uses.values())
    assert len(uses.get("same", [])) <= 2
    capped = mixing.mixed(df, spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int"), total_tokens=10**9)[1].collect()
    assert {r.source: r.tokens for r in capped}["b"] == pytest.approx(3 * got["b"].available, rel=0.01)


def test_a_text_whose_first_copy_has_no_target_is_used(spark):
    df = spark.createDataFrame([(1, "nope", 5, "k1"), (2, "a", 5, "k1"), (3, "a", 5, "k2")], "doc_id long, source string, tokens long, key string")
    mix, _ = mixing.mixed(df, spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int"))
    assert sorted((r.doc_id, r["copy"]) for r in mix.collect()) == [(2, 1), (2, 2), (3, 1), (3, 2)]


@pytest.mark.parametrize("seed", [0, 7])
def test_mix_equals_plain_systematic_sampling(spark, seed):
    rng = random.Random(9)
    docs = [(i, rng.choice(["a", "B ", "c", "x"]), rng.randint(1, 40), f"k{rng.randint(0, 500)}") for i in range(700)]
    df = spark.createDataFrame(docs, "doc_id long, source string, tokens long, key string").repartition(4)
    targets = [("a", 0.5, 2), ("b", 0.25, 3), ("c", 0.25, 4), ("none", 0.1, 2)]
    mix, _ = mixing.mixed(df, spark.createDataFrame(targets, "source string, target_share double, max_repeats int"), seed=seed)
    first = {}
    for i, s, n, k in sorted(docs):
        if s.strip().lower() in "abc":
            first.setdefault(k, (i, s.strip().lower(), n))
    have = {}
    for _, s, n in first.values():
        have[s] = have.get(s, 0) + n
    rows = mixing.plan([{"source": s, "target_share": w, "max_repeats": m} for s, w, m in targets], have, None, seed)
    turn = {r.doc_id: r.t for r in df.select("doc_id", F.xxhash64("doc_id", F.lit(seed)).alias("t")).collect()}
    want = []
    for r in rows:
        texts = sorted((n, turn[i], i) for i, s, n in first.values() if s == r["source"])
        for k, (_, _, i) in enumerate(texts):
            times = int((k + 1) * r["copies"] + r["offset"]) - int(k * r["copies"] + r["offset"])
            want += [(i, c + 1) for c in range(min(times, r["max_repeats"]))]
    assert sorted((r.doc_id, r["copy"]) for r in mix.collect()) == sorted(want)
    assert len({r["offset"] for r in rows}) == 4


def test_mix_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, source string, tokens long, key string")
    mix, report = mixing.mixed(df, spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int"))
    assert mix.count() == 0 and all(r.tokens == 0 for r in report.collect())


def test_token_counts(spark):
    df = spark.createDataFrame([(None,), ("",), ("hello world",), ("a" * 20_000,)], "text string")
    assert [r.tokens for r in counted(df).collect()][:3] == [0, 0, 2]


DOC = "doc_id long, text string, source string, key string, w string, n int"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, " Vault" if i % 2 else None, "k", "w", 1) for i, t in enumerate(texts)], DOC)


def test_truncated(spark):
    rng = random.Random(6)
    things = ["shard map", "write lock", "event log"]
    whole = [f"The {rng.choice('abcdef')} agent restarted the {rng.choice(things)} twice, yet latency fell by {rng.randint(10, 99)} percent." for _ in range(120)]
    whole += [f"# Items {i}\n- restarted the {rng.choice(things)}\n- open: {rng.choice(things)}" for i in range(60)] + [f"Entry {rng.choice('abcdefgh')}{i:02d}x. Still thinking about the {rng.choice(things)}..." for i in range(40)]
    cut = ["The a agent restarted the sh", "The b agent restarted the shard map", "The c agent restarted the write lock twice, yet", "# Items\n- open: shard", "The d agent restarted the eve… [cut]",
           "The e agent restarted the event…", '{"a": [1, 2, {"b": "c"', "```\nrun it", "The f agent restarted the ca�"]
    odd = [None, "", "  \n", "zebra", '{"a": [1]}', " " * 50_000 + "x" * 50_000, "Great!"]
    got = {r.doc_id: r.reason for r in truncation.truncated(documents(spark, whole + cut + odd + cut[:1])).collect()}
    assert not [(i, whole[i], r) for i, r in got.items() if i < len(whole)]
    n = len(whole)
    assert set(got) == {*range(n, n + len(cut)), n + len(cut) + len(odd)}
    assert got[n] == "part" and got[n + 2] == "words" and got[n + 4] == "mark" and got[n + 6] == "structure"


def test_many_grams_are_looked_up_the_same(spark, monkeypatch):
    rng = random.Random(3)
    things = ["shard map", "write lock", "event log"]
    texts = [f"The {rng.choice('abcdef')} agent restarted the {rng.choice(things)} twice, yet latency fell by {rng.randint(10, 99)} percent." for _ in range(80)]
    texts += ["The a agent restarted the sh", "The b agent restarted the shard map", "The c agent restarted the " + "w" * 100_000, "x" * 200_000, "The d agent restarted the" + " " * 60_000 + "write", "[" * 50_000, "- " * 30_000, "a [" + " " * 60_000 + "cut]", "b --" + " " * 60_000 + "more --"]
    df = documents(spark, texts)
    few = {r.doc_id: r.reason for r in truncation.judged(df).collect()}
    monkeypatch.setattr(truncation, "BROADCAST_GRAMS", 0)
    assert {r.doc_id: r.reason for r in truncation.judged(df).collect()} == few
    assert few[80] == "part" and few[81] == "words" and few[87] == few[88] == "mark" and few[84] == "words" and len(few) == len(texts)


def test_signs_of_a_cut(spark):
    marks = {"so it ended [cut]": "so it ended", "so it (cont.)": "so it", "so <TRUNCATED >": "so", "so it -- more --": "so it", "so ---more---": "so", "so {snip}": "so"}
    whole = ["a [cut] b", "[cut", "cut]", "so - more -", "more", "x [link]", "see (more) here"]
    rows = [(i, t) for i, t in enumerate([*marks, *whole])]
    got = {r.i: r.plain for r in truncation.without_mark(spark.createDataFrame(rows, "i int, body string")).collect()}
    assert [got[i] for i in range(len(marks))] == list(marks.values()) and [got[len(marks) + i] for i in range(len(whole))] == whole


def test_no_documents(spark):
    df = documents(spark, ["x"]).limit(0)
    assert truncation.truncated(df).count() == 0 and truncation.truncation_report(df).count() == 0
