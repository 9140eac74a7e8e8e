from __future__ import annotations

import re

from sigstrata.llm import pii_surrogates as ps
from sigstrata.llm.common import table
from tests.conftest import SF_ORACLE

PATTERNS = {k: re.compile(p.replace(r"\p{Lu}", "[A-ZÀ-ÖØ-ÞΑ-ΩА-ЯЁΆΈΉΊΌΎΏ]").replace(r"\p{Ll}", "[a-zß-öø-ÿα-ωа-яёάέήίόύώ]").replace(r"\p{L}", r"[^\W\d_]"))
            for k, p in ps.PATTERNS.items()}
ANY = re.compile("|".join(f"(?P<k{i}>{p.pattern})" for i, p in enumerate(PATTERNS.values())).replace(r"\1", "(?P=sep)").replace("([ -]?)", "(?P<sep>[ -]?)"))


def mentions(text):
    return [(ps.KINDS[int(next(k for k, v in m.groupdict().items() if v is not None and k[0] == "k")[1:])], m.start(), m[0])
            for m in ANY.finditer(text or "")]


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10


def test_corpus_mentions_are_all_replaced_alike_and_apart(spark):
    before = {r.doc_id: r.text for r in table(spark, SF_ORACLE, "documents").collect()}
    after = {r.doc_id: r for r in ps.replace_pii(table(spark, SF_ORACLE, "documents").select("doc_id", "text")).collect()}
    assert len(after) == len(before)
    swapped, real = {}, set()
    for i, text in before.items():
        old, new = mentions(text), mentions(after[i].text)
        assert [k for k, _, _ in old] == [k for k, _, _ in new]
        assert {k: sum(x == k for x, _, _ in old) for k in ps.KINDS} == {k: after[i][f"n_{k}"] for k in ps.KINDS}
        assert ANY.sub("#", text) == ANY.sub("#", after[i].text)         # nothing else changes
        for (k, _, a), (_, _, b) in zip(old, new):
            assert swapped.setdefault((k, a.lower()), b.lower()) == b.lower()
            real.add((k, a.lower()))
            assert re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d", "9", a))) == re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d", "9", b)))
    assert len(swapped) > 60 and len({(k, b) for (k, _), b in swapped.items()}) == len(swapped)
    assert not real & {(k, b) for (k, _), b in swapped.items()}


def swap(docs, rows, **named):
    return {r.doc_id: r.text for r in ps.replace_pii(docs(rows), **named).collect()}


def test_names_keep_gender_script_title_and_coreference(docs):
    rows = [(1, "Mrs Anna Weber met Mr. John Weber."), (2, "then Mrs Weber left John Smith"), (3, "Господин Иванов и Мария Иванова"),
            (4, "Dr Müller-Lang")]
    got = swap(docs, rows)
    a = re.fullmatch(r"Mrs (\w+) (\w+) met Mr\. (\w+) (\w+)\.", got[1])
    b = re.fullmatch(r"then Mrs (\w+) left (\w+) (\w+)", got[2])
    assert a[1].endswith("na") and a[3].endswith("n") and a[2] == a[4] == b[1] and b[2] == a[3] and b[3] != a[2]
    assert {"Anna", "Weber", "John"}.isdisjoint(re.findall(r"\w+", got[1]))
    c = re.fullmatch(r"Господин ([а-яА-Я]+) и ([а-яА-Я]+на) ([а-яА-Я]+)", got[3])
    assert c and c[1] != "Иванов"
    assert re.fullmatch(r"Dr [A-Z][a-z]+", got[4]) and got == swap(docs, rows) != swap(docs, rows, key="other")


def test_numbers_keep_format(docs):
    rows = [(1, "4111 1111 1111 1111 or 4111-1111-1111-1111 or 4111111111111111"), (2, "078-05-1120, (212) 555-0199, 212-555-0199 +44 20 7946 0958"),
            (3, "10.0.0.255 A.Bc@Ex-am.CO.uk a.bc@ex-am.co.uk 999.1.1.1 1.2.3.4.5")]
    got = swap(docs, rows)
    cards = re.findall(r"\d[\d -]+\d", got[1])
    assert len({re.sub(r"\D", "", c) for c in cards}) == 1 and luhn(re.sub(r"\D", "", cards[0])) == 0 and cards[0][0] == "4"
    assert re.fullmatch(r"\d{3}-\d\d-\d{4}, \(\d{3}\) \d{3}-\d{4}, \d{3}-\d{3}-\d{4} \+44 \d\d \d{4} \d{4}", got[2]) and got[2] != rows[1][1]
    tel = re.findall(r"\d{3}", got[2].split(", ", 1)[1])
    assert "".join(re.findall(r"\d", got[2].split(", ")[1])) == "".join(re.findall(r"\d", got[2].split(", ")[2].split(" ")[0])) and tel
    ip, one, two, bad, five = got[3].split()
    assert re.fullmatch(r"\d\d\.\d\.\d\.\d{3}", ip) and all(int(x) < 256 for x in ip.split("."))
    assert re.fullmatch(r"[A-Z]\.[A-Z][a-z]@[A-Z][a-z]-[a-z]{2}\.[A-Z]{2}\.uk", one) and one.lower() == two
    assert (bad, five) == ("999.1.1.1", "1.2.3.4.5")


def test_collisions_are_redrawn(spark, docs):
    # more one-letter addresses than would stay apart by chance
    rows = [(i * 26 + j, f"{a}@{b}.io") for i, a in enumerate("abcdefghijkl") for j, b in enumerate("abcdefghijklmnopqrstuvwxyz")]
    entity = spark.createDataFrame([("email", t) for _, t in rows], "kind string, norm string")
    tries = ps.attempts(entity, "surrogate key").collect()
    assert max(r.attempt for r in tries) > 0 and len(tries) == len(rows)
    got = swap(docs, rows)
    assert len(set(got.values())) == len(rows) and not set(got.values()) & {t for _, t in rows}


def test_a_full_format_is_left(docs):
    quads = [f"{a}.{b}.{c}.{d}" for a in range(1, 10) for b in range(1, 10) for c in range(1, 10) for d in range(1, 10)]
    mails = [f"{a.upper()}@{b}.cc" for a in ps._LOWER for b in ps._LOWER]
    rows = [(i, " ".join(quads[i::20] + mails[i::20] + ["_@-.io"])) for i in range(20)]
    got = swap(docs, rows)
    new = [x for i in range(20) for x in got[i].split()[:-1]]
    assert len(new) == len({x.lower() for x in new}) == len(quads) + len(mails) and not {x.lower() for x in new} & {x.lower() for x in quads + mails}
    assert all(re.fullmatch(r"[a-z]*[A-Z]@[a-z]\.cc", x) if "@" in x else all(0 < int(n) < 256 for n in x.split(".")) and x.count(".") == 3 for x in new)
    assert len({got[i].split()[-1] for i in range(20)}) == 1 and re.fullmatch(r"[a-z]+_@-\.io", got[0].split()[-1])


def test_edges(docs):
    rows = [(1, None), (2, ""), (3, "plain"), (None, "x@y.org"), (4, "x@y.org"), (4, "x@y.org"), (5, "a@b.cc " * 5_000), (6, "z" * 200_000)]
    df = docs(rows).withColumnRenamed("lang", "n_email").withColumnRenamed("source", "kind")
    got = ps.replace_pii(df).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.text, r.n_email))
    assert by[1] == [(None, 0)] and by[2] == [("", 0)] and by[3] == [("plain", 0)]
    assert by[None] == by[4][:1] == by[4][1:] and by[4][0][1] == 1 and by[5][0][1] == 5000 and by[6][0][0] == "z" * 200_000
    assert ps.replace_pii(df.limit(0)).collect() == []


def test_no_python_in_the_plan(spark):
    plan = ps.replace_pii(table(spark, SF_ORACLE, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_columns_of_any_name_are_kept(docs):
    df = docs([(i, f"a{i}@b.cc x@y.cc") for i in range(40)]).selectExpr("*", "1 as _pi_found", "2 as _pi_row", "3 as _PI_id", "4 as n_ip")
    got = ps.replace_pii(df)
    assert [c for c in got.columns if c not in ("n_ip", "n_email", "n_card", "n_ssn", "n_phone", "n_name")] == [c for c in df.columns if c not in ("n_ip", "n_email", "n_card", "n_ssn", "n_phone", "n_name")]
    assert all((r["_pi_found"], r["_pi_row"], r["_PI_id"], r["n_ip"], r["n_email"]) == (1, 2, 3, 0, 2) for r in got.collect())


def test_one_person_has_one_name_whatever_the_title(docs):
    got = swap(docs, [(1, "Dr Alex Smith met Mr Alex Smith"), (2, "Mrs Anna spoke. Anna Weber nodded"), (3, "Prof Alex Jones"),
                      (4, "Mrs Kim Lee"), (5, "Mr Kim Lee"), (6, "Mr. Kim Park")])
    a = re.fullmatch(r"Dr (\w+) (\w+) met Mr (\w+) (\w+)", got[1])
    assert a[1] == a[3] and a[2] == a[4] and a[1].endswith("n") and got[3].split()[1] == a[1]
    b = re.fullmatch(r"Mrs (\w+) spoke\. (\w+) (\w+) nodded", got[2])
    assert b[1] == b[2] != b[3] and b[1].endswith("na")
    kim = {got[i].split()[1] for i in (4, 5, 6)}            # two documents say Mr, one Mrs
    assert len(kim) == 1 and kim.pop().endswith("n") and got[4].split()[2] == got[5].split()[2]


def test_bare_repeats_of_a_name_are_replaced(docs):
    text = "Weber was early. Anna Weber came; Anna left, Weber's hat too. Annabel and Weber-Lang stay, so does weber."
    got = ps.replace_pii(docs([(1, text), (2, "Anna left and Weber was seen")])).collect()
    by = {r.doc_id: r for r in got}
    m = re.fullmatch(r"(\w+) was early\. (\w+) (\w+) came; (\w+) left, (\w+)'s hat too\. Annabel and Weber-Lang stay, so does weber\.", by[1].text)
    assert m and m[1] == m[3] == m[5] and m[2] == m[4] and {"Anna", "Weber"}.isdisjoint(m.groups()) and by[1].n_name == 4
    assert by[2].text == "Anna left and Weber was seen" and by[2].n_name == 0      # no full mention there


def test_phones_keep_their_country_code_and_are_one_in_any_format(docs):
    rows = [(1, "+1 555 123 4567 or (555) 123-4567 or 555.123.4567 or +15551234567"), (2, "+49 30 1234567"), (3, "+33 1 23456789, +33 1 23 45 67 89"),
            (4, "+420 2 21234567"), (5, "+7 (495) 123-45-67"), (6, "+1 (743) 555-3824 2024")]
    got = swap(docs, rows)
    digits = [re.sub(r"\D", "", x) for x in got[1].split(" or ")]
    assert digits[0] == digits[3] == "1" + digits[1] and digits[1] == digits[2] != "5551234567"
    assert re.fullmatch(r"\+1 \d{3} \d{3} \d{4} or \(\d{3}\) \d{3}-\d{4} or \d{3}\.\d{3}\.\d{4} or \+1\d{10}", got[1])
    assert re.fullmatch(r"\+49 \d\d \d{7}", got[2]) and re.fullmatch(r"\+420 \d \d{8}", got[4]) and re.fullmatch(r"\+7 \(\d{3}\) \d{3}-\d\d-\d\d", got[5])
    first, second = got[3].split(", ")
    assert re.fullmatch(r"\+33 \d \d{8}", first) and first.replace(" ", "") == second.replace(" ", "")
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4} 2024", got[6])
    assert all(got[i] != t for i, t in rows)


def test_a_full_number_format_gets_longer_numbers(spark):
    rows = [("ssn", "078051120"), ("card", "4111111111111111"), ("phone", "49 301234567")]
    mention = {"ssn": "078-05-1120", "card": "4111 1111 1111 1111", "phone": "+49 30 1234567"}
    df = spark.createDataFrame([(k, n, mention[k]) for k, n in rows], "kind string, norm string, mention string")
    c = ps.F.col
    new = ps.surrogate(c("kind"), c("norm"), ps.F.lit("n"), ps.F.lit(2 * ps.WIDER), "k")
    got = {r.kind: (r.new, r.text) for r in df.select("kind", new.alias("new"), ps._written(c("mention"), ps.F.array(new)).alias("text")).collect()}
    assert {k: len(re.sub(r"\D", "", v)) for k, (v, _) in got.items()} == {"ssn": 11, "card": 18, "phone": 13}
    assert luhn(got["card"][0]) == 0 and all(re.sub(r"\D", "", a) == re.sub(r"\D", "", b) for a, b in got.values())
    assert re.fullmatch(r"\+49 \d\d \d{9}", got["phone"][1])


def test_drawing_is_spread_over_tasks(spark):
    entity = spark.createDataFrame([("ip", f"10.0.{i % 200}.{i // 200}") for i in range(2000)], "kind string, norm string")
    parts = ps.attempts(entity, "k").rdd.glom().map(len).collect()
    assert len(parts) == int(spark.conf.get("spark.sql.shuffle.partitions")) and min(parts) > 100


def test_planted_values_leave_the_text(docs):
    """Mentions found by the values that were planted, not by the operator's patterns."""
    planted = {"email": ["jo.doe+x@mail.example.org", "A_b@x-y.co"], "ip": ["192.168.17.4", "8.8.4.4"],
               "card": ["5500 0000 0000 0004", "340000000000009"], "ssn": ["219-09-9999"],
               "phone": ["+44 20 7946 0958", "+33 1 23456789", "(555) 010-9999", "555-010-1234", "+4915112345678"],
               "name": ["Mr Bruno Ganz", "Frau Özil", "Sophie Marceau", "Господин Петров", "Μαρία Κάλλας"]}
    clean = ["version 2.10", "ISBN 978-3-16-148410-0", "room 12-34-5", "at 10:30 on 2024-05-17", "Berlin and Paris", "x = y @ z", "1,234,567.89"]
    frames = ["{}", "{}.", "({})", "see {}, then", "a\n{}\nb", "«{}»", "x; {}: y"]
    rows, want = [], {}
    for kind, values in planted.items():
        for v in values:
            for f in frames:
                rows.append((len(rows), f.format(v)))
                want[len(rows) - 1] = (kind, v)
    rows += [(len(rows) + i, t) for i, t in enumerate(clean)]
    got = {r.doc_id: r for r in ps.replace_pii(docs(rows)).collect()}
    for i, t in rows:
        if i not in want:
            assert got[i].text == t
            continue
        kind, v = want[i]
        assert v not in got[i].text and got[i][f"n_{kind}"] == 1, (t, got[i].text)
        core = [w for w in v.split() if w not in ps.MALE_TITLES + ps.FEMALE_TITLES] if kind == "name" else []
        assert not any(w in got[i].text for w in core)
