"""Permutations are one to one, and what they replace stays valid and linked."""

import datetime
import re

import pytest

from corpuscle.llm import pseudonyms as p

KEY = b"k" * 32


@pytest.mark.parametrize("size", [1, 2, 3, 7, 10, 97, 1000, 1024])
def test_permutation_is_one_to_one(size):
    image = [p.permute(v, size, KEY, "t") for v in range(size)]
    assert sorted(image) == list(range(size))
    if size >= 97:
        assert image != [p.permute(v, size, b"other", "t") for v in range(size)]


def luhn_ok(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(d)) % 10 == 0


def test_formats_stay_valid():
    card = p.card("4111-1111 1111-1111", KEY)
    assert luhn_ok(card) and re.fullmatch(r"\d{4}-\d{4} \d{4}-\d{4}", card) and card != "4111-1111 1111-1111"
    assert p.card("4111 1111 1111 1112", KEY) is None
    iban = p.iban("GB82 WEST 1234 5698 7654 32", KEY)
    plain = iban.replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1 and iban.startswith("GB") and " WEST " in iban
    assert p.iban("GB83 WEST 1234 5698 7654 32", KEY) is None
    for s in ("2024-02-29", "31.12.1999", "12/31/1999"):
        new = p.date(s, KEY)
        assert re.sub(r"\d", "9", new) == re.sub(r"\d", "9", s) and p.date(new, KEY) is not None
    assert p.date("2023-02-29", KEY) is None and p.date("45/45/1999", KEY) is None
    datetime.date.fromisoformat(p.date("2024-02-29", KEY))
    assert all(0 <= int(x) <= 255 for x in p.address("192.168.0.1", KEY).split(".")) and p.address("1.2.3.256", KEY) is None
    a, b, c = p.social("123-45-6789", KEY).split("-")
    assert 1 <= int(a) <= 899 and a != "666" and b != "00" and c != "0000" and p.social("000-12-1234", KEY) is None
    assert p.phone("+44 20 7946 0958", KEY).startswith("+44 ")
    assert re.fullmatch(r"[a-z]+\.[a-z]+\d\d@example\.com", p.email("jane.doe42@example.com", KEY))


def test_different_values_stay_different():
    cards = [p.card(s + str(p._luhn(s)), KEY) for s in (f"{k:015d}" for k in range(4111, 4511))]
    assert len(set(cards)) == 400
    days = [(datetime.date(2001, 1, 1) + datetime.timedelta(k)).isoformat() for k in range(400)]
    assert len({p.date(d, KEY) for d in days}) == 400


def test_documents(spark):
    text = "Card 4111 1111 1111 1111, mail jane.doe@example.com, born 1980-05-17, call (555) 123-4567. Order x4111 stays, v1.2.3 too."
    rows = [(1, text), (2, "again 4111 1111 1111 1111"), (3, None), (4, ""), (None, text), (1, text), (5, "word " * 50_000 + "1980-05-17"), (6, "naïve 4111 1111 1111 1112 käse 12")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, kinds string")
    out = p.pseudonymised(df, KEY).collect()
    assert len(out) == len(rows)
    by = {r["doc_id"]: r for r in out}
    assert by[1]["kinds"] == "card:1,date:1,email:1,phone:1" and by[1]["n_replaced"] == 4
    assert "4111 1111" not in by[1]["text"] and "x4111 stays, v1.2.3 too." in by[1]["text"] and "@example.com" in by[1]["text"]
    assert by[2]["text"][6:] in by[1]["text"]  # linked
    assert by[3]["text"] is None and by[4]["text"] == "" and by[6]["text"] == rows[7][1] and by[6]["n_replaced"] == 0
    assert by[None]["text"] == by[1]["text"]
    assert by[5]["text"][:-10] == rows[6][1][:-10] and by[5]["text"][-10:] in by[1]["text"]
    assert p.pseudonymised(df.where("false"), KEY).count() == 0


def test_clean_texts_are_left_alone(spark):
    texts = ["Chapter 12, page 345.", "In 1999 there were 1234567 people.", "3.14159 and 10:30", "ratio 1/2/3", "ISBN 978-3-16-148410-0"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["text"] for r in p.pseudonymised(df, KEY).orderBy("doc_id").collect()] == texts


@pytest.mark.parametrize("value, kept", [
    ("+14155550123", "+1"), ("+49 151 23456789", "+49 "), ("+33 6 12 34 56 78", "+33 "), ("06 12 34 56 78", "0"), ("0151 23456789", "0"), ("030/1234567", "0"), ("+49 (0) 151 23456789", "+49 (0) "),
    ("0049 151 23456789", "0049 "), ("0612345678", "0"), ("(030) 12345678", "(0"), ("+9 (999) 999-9999", "+9 ("),
])
def test_phone_layouts(value, kept):
    new, counts = p.Pseudonymiser(KEY).replace(f"call {value}, or not.")
    assert counts == {"phone": 1} and value not in new
    assert new.startswith(f"call {kept}") and re.sub(r"\d", "9", new) == re.sub(r"\d", "9", f"call {value}, or not.")


def test_layouts_of_a_number_are_linked():
    own = p.Pseudonymiser(KEY)
    for layouts, n in ((["+14155550123", "+1 415 555 0123", "+1 (415) 555-0123"], 10), (["+33612345678", "+33 6 12 34 56 78", "06 12 34 56 78", "0612345678", "+33 (0)6 12 34 56 78"], 9)):
        assert len({p._digits(own.replace(x)[0])[-n:] for x in layouts}) == 1
    text = "06 12 34 56 78 2024 and +49 151 23456789 2024-05-17"
    new, counts = own.replace(text)
    assert counts == {"phone": 2, "date": 1} and " 2024 and " in new
    numbers = [p.phone(f"+1 415 {k:03d} 0123", KEY) for k in range(300)]
    assert len(set(numbers)) == 300


def test_dates_before_a_time_and_short_years():
    own = p.Pseudonymiser(KEY)
    new, counts = own.replace("born 1980-05-17T00:00:00Z, 1980-05-17 and 17.05.80, 05/17/80")
    assert counts == {"date": 4} and new.endswith(re.search(r"\d\d/\d\d/\d\d$", new).group())
    assert new[5:15] == new[27:37] and new[15:25] == "T00:00:00Z" and new[5:15] != "1980-05-17"
    days = [(datetime.date(1999, 1, 1) + datetime.timedelta(k)).strftime("%d.%m.%y") for k in range(800)]
    assert len({p.date(d, KEY) for d in days}) == 800
    assert own.replace("10.10.80.12")[1] == {"ip": 1} and own.replace("1.2.10 and 3.2.15")[1] == {}


def test_key_is_the_callers(spark):
    from corpuscle.llm.queries import pseudonym_key

    df = spark.createDataFrame([(1, "4111 1111 1111 1111")], "doc_id long, text string")
    one, again, other = (p.pseudonymised(df, k).first()["text"] for k in (KEY, KEY, b"other"))
    assert one == again != other
    with pytest.raises(TypeError):
        p.pseudonymised(df)
    assert pseudonym_key(spark) != pseudonym_key(spark)
    spark.conf.set("spark.corpuscle.pseudonyms.key", "00ff")
    assert pseudonym_key(spark) == b"\x00\xff"
    spark.conf.unset("spark.corpuscle.pseudonyms.key")


def test_overlaps_and_columns_that_clash(spark):
    df = spark.createDataFrame([(None, "06.12.34.56.78@example.com", "a", 1)], "doc_id long, text string, __kinds string, __replaced int")
    r = p.pseudonymise(df, KEY).first()
    assert r["__kinds"] == "email:1" and r["__replaced"] == 1 and r["text"].endswith("@example.com") and r["doc_id"] is None
    local = "a" * 64
    assert p.Pseudonymiser(KEY).replace(f"{local}@example.com")[1] == {"email": 1} and p.Pseudonymiser(KEY).replace(f"{local}a@example.com")[1] == {}


def plain_numbers(text):
    """An independent detection of card numbers and IPv4 addresses that stand between blanks."""
    found = {}
    for word in text.replace(",", " ").split("  "):
        word = word.strip()
        d = [int(c) for c in word if c.isdigit()]
        if re.fullmatch(r"\d{4}( \d{4}){3}", word) and sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(d[::-1])) % 10 == 0 and len(set(d)) > 1:
            found["card"] = found.get("card", 0) + 1
        elif re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", word) and all(int(x) < 256 for x in word.split(".")):
            found["ip"] = found.get("ip", 0) + 1
    return found


def test_detection_against_plain_code():
    import random

    r = random.Random(7)
    own = p.Pseudonymiser(KEY)
    for _ in range(300):
        values = []
        for _ in range(r.randint(1, 5)):
            body = "".join(r.choice("0123456789") for _ in range(15))
            card = body + (str(p._luhn(body)) if r.random() < 0.6 else r.choice("0123456789"))
            values.append(r.choice([" ".join(card[k : k + 4] for k in (0, 4, 8, 12)), ".".join(str(r.randint(0, 300)) for _ in range(4))]))
        text = "  and  ".join(["x", *values, "y"])
        new, counts = own.replace(text)
        assert {k: counts.get(k, 0) for k in ("card", "ip") if counts.get(k)} == plain_numbers(text), text
