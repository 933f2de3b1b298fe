import re

from webspark.llm import surrogates as sg

TEXTS = [
    (1, "Write to anna.k@mail.example.com or ANNA.K@MAIL.EXAMPLE.COM, call +1 (212) 555-7713 or +12125557713 hm (212) 555-7713."),
    (2, "anna.k@mail.example.com; card 4111 1111 1111 1111, or 4111111111111111, not 4111111111111112. ip 129.38.82.176###"),
    (3, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" TOKEN = "04DBEBAB91AB85687D33EEAAF9AC699E1188F962"!!'),
    (4, "Mrs. Anna Miller met Mr. Miller, Frau Miller and Herr Tom Jones. г-жа Анна Иванова"),
    (5, None),
    (6, ""),
    (7, "Nothing private: version 3.0, 12 of 2024, 1.2.3.4.5 and a@b"),
    (None, "ip 129.38.82.176"),
    (8, "x" * 200000 + " b@c.de " + "1" * 100000),
    (9, "same 129.38.82.176 row"),
    (9, "same 129.38.82.176 row"),
    (10, "überall.34@mail7.example.de, e1@x.org e2@x.org e3@x.org e4@x.org e5@x.org"),
]


def _luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def test_replacements(spark, texts):
    docs = texts(*TEXTS)
    out = sg.replace_private(docs, "k1")
    assert out.columns == [*docs.columns, "n_replaced"] and out.count() == len(TEXTS)
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    n = {r["doc_id"]: r["n_replaced"] for r in out.collect()}
    everything = "\n".join(t or "" for t in got.values()).lower()
    for private in ("anna.k", "7713", "41111111", "1111 1111", "129.38", "04dbe", "miller", "tom jones", "иванова", "überall", "b@c.de"):
        assert private not in everything
    # The same entity has the same surrogate, in the writing of the mention.
    low, up, phone, plain, short = re.match(r"Write to (\S+) or (\S+), call (.{17}) or (\S+) hm (.{14})\.$", got[1]).groups()
    assert low.endswith(".com") and up == low.upper() and re.fullmatch(r"[a-z]{4}\.[a-z]@example\.com", low)
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", phone) and re.sub(r"\D", "", phone) == plain[1:]
    first, spaced, joined, other, ip = re.match(r"(\S+); card (.{19}), or (\d{16}), not (\d{16})\. ip (\S+)###$", got[2]).groups()
    assert first == low and spaced.replace(" ", "") == joined != other
    assert _luhn(joined) and not _luhn(other) and joined[0] == "4"
    assert ip.startswith("10.") and got[None] == f"ip {ip}" and got[9] == f"same {ip} row"
    secret = re.findall(r'"(\w+)"', got[3])
    assert re.fullmatch(r"[0-9a-f]{40}", secret[0]) and secret[1] == secret[0].upper()
    names = re.match(r"Mrs\. (\w+) (\w+) met Mr\. (\w+), Frau (\w+) and Herr (\w+) (\w+)\. г-жа (\w+) (\w+)$", got[4]).groups()
    assert names[1] == names[2] == names[3] and names[5] != names[1]
    women = sg.NAMES["latin", "female"].split()
    assert any(names[0].startswith(w) for w in women) and any(names[4].startswith(w) for w in sg.NAMES["latin", "male"].split())
    assert re.fullmatch(r"[А-Яа-я]+", names[6]) and re.fullmatch(r"[А-Яа-я]+", names[7])
    assert got[7] == TEXTS[6][1] and n[7] == 0 and got[5] is None and got[6] == "" and n[5] == 0
    assert n[1] == 5 and n[8] == 1 and n[9] == 1
    assert len(set(re.findall(r"\w+@example.org", got[10]))) == 5
    assert sg.replace_private(docs.limit(0), "k").count() == 0


def test_keys(spark, texts):
    docs = texts(*TEXTS[:4])
    one, again, other = ([r["text"] for r in sg.replace_private(docs, k).orderBy("doc_id").collect()] for k in ("a", "a", "b"))
    assert one == again and all(x != y for x, y in zip(one, other, strict=True))


def test_surrogates_stay_apart_in_a_full_space(spark):
    # 600 one-letter locals of two characters: far more than draws without collision allow.
    rows = [("email", f"{a}{b}@x.{t}") for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmno" for t in ("com", "org")]
    rows += [("surname", f"name{k}") for k in range(60)]
    made = sg.surrogates(spark.createDataFrame(rows, "kind string, entity string"), "k").collect()
    assert len(made) == len(rows) and len({(r["kind"], r["surrogate"]) for r in made}) == len(rows)
    assert not {(r["kind"], r["surrogate"]) for r in made} & set(rows)


def test_layouts_names_and_untitled_mentions(spark, texts):
    phones = ["+44 20 7946 0958", "555 123 4567", "+1 555 123 4567", "+49 30 12345678", "+33 1 23 45 67 89", "030/1234567", "5551234567", "020 7946 0958", "01 23 45 67 89"]
    plain = "On 2024-10-12, 12.10.2024 at 1700000000: 1 000 000 of 10/2024, 3.14159265, 1234567 and 192.168.100 stay."
    rows = [(k, f"Call {p}, please.") for k, p in enumerate(phones)]
    rows += [(20, plain), (21, "Mr John Ronald Tolkien and Mr. J. Smith came. Smith said: Tolkien's book, SMITH! a smith, Smithson. Herr Ludwig van Beethoven"), (22, "Smith alone")]
    got = {r["doc_id"]: (r["text"], r["n_replaced"]) for r in sg.replace_private(texts(*rows), "k").collect()}
    digits = {}
    for k, p in enumerate(phones):
        text, n = got[k]
        assert n == 1 and text != rows[k][1] and re.sub(r"\d", "#", text) == re.sub(r"\d", "#", rows[k][1])
        digits[p] = re.sub(r"\D", "", text)
    assert digits["+44 20 7946 0958"][2:] == digits["020 7946 0958"][1:] and digits["+33 1 23 45 67 89"][2:] == digits["01 23 45 67 89"][1:]
    assert digits["555 123 4567"] == digits["5551234567"] == digits["+1 555 123 4567"][1:]
    assert got[20] == (plain, 0) and got[22] == ("Smith alone", 0)
    text, n = got[21]
    found = re.match(r"Mr (\w+) (\w+) (\w+) and Mr\. ([A-Z])\. (\w+) came\. (\w+) said: (\w+)'s book, (\w+)! a smith, Smithson\. Herr (\w+) (\w+)$", text).groups()
    assert found[4] == found[5] and found[7] == found[4].upper() and found[6] == found[2] and n == 6
    assert not {"John", "Ronald", "Tolkien", "Smith", "SMITH", "Ludwig", "Beethoven"} & set(found)


def test_addresses_grow_too(spark):
    left = spark.range(5000).selectExpr("'ip' AS kind", "concat('1.2.', id div 200, '.', id % 200) AS entity")
    made = [r["surrogate"] for r in sg._draw(left, "k", sg.SAME_LENGTH_DRAWS).collect()]
    assert len(set(made)) == 5000 and all(re.fullmatch(r"fd[0-9a-f]{2}(:[0-9a-f]{4}){7}", m) for m in made)
