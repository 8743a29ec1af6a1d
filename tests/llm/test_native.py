import datetime as dt
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from evidentia.llm import pii, quotes

from .fixtures import as_parquet, frame, hard_rows


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def pseudonyms(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [r for r in pii.pseudonymise(rows).orderBy("doc_id").collect()]


def test_values_keep_their_format_and_stay_linked(spark):
    rng = random.Random(1)
    cards = []
    while len(cards) < 60:
        c = "".join(rng.choice("0123456789") for _ in range(16))
        if luhn(c):
            cards.append(c)
    found = pseudonyms(spark, [f"pay {c} now" for c in cards] + [f"again {cards[0][:4]} {cards[0][4:8]} {cards[0][8:12]} {cards[0][12:]}"])
    new = [re.sub(r"\D", "", r.text) for r in found]
    assert all(len(n) == 16 and luhn(n) for n in new) and len(set(new[:-1])) == 60 and new[-1] == new[0]
    assert not set(new[:-1]) & set(cards)


@pytest.mark.parametrize(
    ("text", "pattern", "kind"),
    [
        ("a.b-1@Mail.example.com", r"[a-z]\.[a-z]-\d@Mail\.example\.com", "email"), ("+1 (743) 555-3824", r"\+1 \(\d{3}\) \d{3}-\d{4}", "phone"), ("(743) 555-3824", r"\(\d{3}\) \d{3}-\d{4}", "phone"),
        ("196.3.67.149", r"\d{1,3}(\.\d{1,3}){3}", "ip"), ("2021-02-28", r"\d{4}-\d\d-\d\d", "date"), ("28.02.2021", r"\d\d\.\d\d\.\d{4}", "date"), ("2/8/2021", r"\d{1,2}/\d{1,2}/\d{4}", "date"),
        ('token = "b44e15aabb"', r'token = "[a-z]\d\d[a-z]\d\d[a-z]{4}"', "secret"), ("DE89370400440532013000", r"DE\d{20}", "iban"), ("123-45-6789", r"\d{3}-\d{2}-\d{4}", "ssn"),
    ],
)
def test_kinds(spark, text, pattern, kind):
    row = pseudonyms(spark, [f"see {text}, ok"])[0]
    assert row.found == [kind] and row.text != f"see {text}, ok" and re.fullmatch(f"see {pattern}, ok", row.text)


@pytest.mark.parametrize("text", ["4111111111111112", "999.1.1.1", "2021-02-30", "31.02.2021", "1899-12-31", "DE00370400440532013000", "000-12-3456", "v3.11.2", "1.2.3.4.5", "page 12", "key idea"])
def test_what_is_not_valid_stays(spark, text):
    row = pseudonyms(spark, [f"see {text} ok"])[0]
    assert row.found == [] and row.text == f"see {text} ok"


def test_dates_are_permuted_within_the_calendar(spark):
    days = [dt.date(1900, 1, 1) + dt.timedelta(days=n) for n in range(0, 73_049, 97)]
    found = pseudonyms(spark, [d.isoformat() for d in days])
    new = [dt.date.fromisoformat(r.text) for r in found]
    assert len(set(new)) == len(days) and all(1900 <= d.year <= 2099 for d in new)
    assert pseudonyms(spark, [days[5].strftime("%d.%m.%Y")])[0].text == new[5].strftime("%d.%m.%Y")


def test_permutation_is_one_to_one(spark):
    rows = spark.range(17 * 43).select(pii.permuted(F.floor(F.col("id") / 43), F.col("id") % 43, F.lit(17), F.lit(43), "k", "t").alias("p"))
    found = {(r.p.a, r.p.b) for r in rows.collect()}
    assert len(found) == 17 * 43 and all(0 <= a < 17 and 0 <= b < 43 for a, b in found)
    digits = spark.range(1_000).select(pii.permuted_digits(F.lpad(F.col("id").cast("string"), 3, "0"), "k", "t").alias("d"))
    assert {r.d for r in digits.collect()} == {f"{i:03d}" for i in range(1_000)}


def test_pii_on_hard_rows(spark, tmp_path):
    found = pii.pseudonymise(as_parquet(spark, tmp_path)).collect()
    assert sorted(((r.doc_id, r.text) for r in found), key=repr) == sorted(hard_rows(), key=repr)
    assert pii.pseudonymise(frame(spark, [])).count() == 0


def conversation(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, position string")


def test_quotes(spark):
    first, second = "Hello there everyone here\nHow do we deploy the thing?", "First you build it well.\n\nThen you ship it out."
    rows = [
        (1, 0, "user", first), (1, 1, "assistant", second), (1, 2, "user", "On Monday X wrote:\n> How do we deploy the thing?\nI would also know that, thanks"),
        (1, 3, "assistant", "> > How do we deploy the thing?\n> I would also know  that, Thanks\n\nSee above please now"), (1, 4, "user", "> Then you ship it out.\nok fine"), (1, 5, "user", "> nobody ever said this\nreally"),
        (1, 6, "user", ">> Hello there everyone here\n>> How do we deploy the thing?\n> x\nlast"), (2, 0, "user", "How do we deploy the thing?"), (2, 1, None, None), (2, 1, None, None), (None, None, "user", "> lone quote of something\n"), (2, None, "a", ""),
    ]
    found = sorted((r for r in quotes.reply_ordered(conversation(spark, rows)).collect()), key=lambda r: (r.conv_id or -1, r.position))
    one = [(r.turn, r.position, r.reply_to, r.linked, r.quotes, r.max_level, r.body) for r in found if r.conv_id == 1]
    assert one == [
        (0, 0, None, False, 0, 0, first), (1, 1, 0, False, 0, 0, second), (2, 2, 0, True, 1, 1, "I would also know that, thanks"), (3, 3, 2, True, 2, 2, "See above please now"),
        (4, 4, 1, True, 1, 1, "ok fine"), (5, 5, 4, False, 1, 1, "really"), (6, 6, 5, False, 2, 2, "last"),
    ]
    assert [(r.turn, r.position, r.reply_to, r.body) for r in found if r.conv_id == 2] == [(None, 0, None, ""), (0, 1, None, "How do we deploy the thing?"), (1, 2, 0, ""), (1, 3, 1, "")]
    assert [(r.position, r.quotes, r.body) for r in found if r.conv_id is None] == [(0, 1, "")]


def test_short_and_deeper_quotes(spark):
    rows = [
        (1, 0, "a", "Yes, do it"), (1, 1, "b", "ok thanks\n\nAnd one more thing to say"), (1, 2, "a", "something else entirely"), (1, 3, "b", "> Yes, do it\nwell"), (1, 4, "a", "> ok thanks\nfine"),
        (1, 5, "b", ">\n>> something else entirely\nso"), (1, 6, "a", "> ok thanks\nbut\n> And one more thing to say\n>> Yes, do it\nend"), (1, 7, "b", "> no such\n>> something else entirely\nlast"),
    ]
    found = {r.turn: (r.reply_to, r.linked) for r in quotes.reply_ordered(conversation(spark, rows)).collect()}
    assert [found[t] for t in range(3, 8)] == [(0, True), (1, True), (2, True), (1, True), (6, False)]
    links = {(r.turn, r.first_line, r.level): r.original for r in quotes.passage_links(conversation(spark, rows)).collect()}
    assert links == {(3, 0, 1): 0, (4, 0, 1): 1, (5, 1, 2): 2, (6, 0, 1): 1, (6, 2, 1): 1, (6, 3, 2): 0, (7, 0, 1): None, (7, 1, 2): 2}


def test_long_conversations_are_numbered_in_blocks(spark):
    rows = [(1, t, "user", "the same line of words" if t % 2 else f"message number {t} with words") for t in range(3_000)] + [(1, 3_000, "user", "> message number 4 with words\nyes"), (1, 3_001, "user", "> the same line of words\nno")]
    found = {r.turn: r for r in quotes.reply_ordered(conversation(spark, rows)).collect()}
    assert [found[t].position for t in range(3_002)] == list(range(3_002))
    assert all(found[t].reply_to == t - 1 for t in range(1, 3_000)) and found[3_000].reply_to == 4 and found[3_001].reply_to == 2_999


def test_no_conversations(spark):
    assert quotes.reply_ordered(conversation(spark, [])).count() == 0


def walked(parents):
    """Places of a walk through the tree that ``parents`` (of 1, 2, ...) give."""
    children = {i: [] for i in range(len(parents) + 1)}
    for i, p in enumerate(parents, 1):
        children[p].append(i)
    order, stack = [], [0]
    while stack:
        order.append(stack.pop())
        stack += reversed(children[order[-1]])
    return {v: k for k, v in enumerate(order)}


def test_reply_places_against_a_walk(spark, monkeypatch):
    monkeypatch.setattr(quotes, "BLOCK", 4)
    rng = random.Random(12)
    trees = [[rng.choice([i - 1, i - 1, rng.randrange(i), 0]) for i in range(1, n)] for n in [1, 2, 3, 9, 30, 60] for _ in range(4)] + [list(range(40)), [0] * 30]
    rows = [(c, i, None if i == 0 else t[i - 1]) for c, t in enumerate(trees) for i in range(len(t) + 1)]
    found = quotes.reply_places(spark.createDataFrame(rows, "conv_id long, place long, parent long")).collect()
    mine = {(r.conv_id, r.place): r.reply_place for r in found}
    for c, t in enumerate(trees):
        straight = t == list(range(len(t)))
        assert {i: mine.get((c, i)) for i in range(len(t) + 1)} == ({i: None for i in range(len(t) + 1)} if straight else walked(t))


def test_reply_order(spark):
    rows = [(1, 0, "a", "How do we deploy it?"), (1, 1, "b", "First you build it."), (1, 2, "a", "> How do we deploy it?\nNobody knows"), (1, 3, "b", "so be it"), (1, 4, "a", "> First you build it.\nand then"), (2, 0, "a", "x"), (2, 1, "b", "> x\ny")]
    found = quotes.reply_ordered(conversation(spark, rows)).collect()
    assert [r.turn for r in sorted((r for r in found if r.conv_id == 1), key=lambda r: r.reply_position)] == [0, 1, 4, 2, 3]
    assert [r.reply_position for r in sorted((r for r in found if r.conv_id == 2), key=lambda r: r.turn)] == [0, 1]


def test_messages_without_turns_are_numbered_in_blocks(spark, tmp_path):
    conversation(spark, [(1, None, "user", f"m{i}") for i in range(5_000)] + [(1, 7, "user", "end")]).repartition(3).write.parquet(f"{tmp_path}/c")
    found = quotes.reply_ordered(spark.read.parquet(f"{tmp_path}/c")).collect()
    assert sorted(r.position for r in found) == list(range(5_001)) and [r.position for r in found if r.turn == 7] == [5_000]


KEY = "a key"


def h(tag, i, value):
    return int(hashlib.sha256(f"{KEY}|{tag}|{i}|{value}".encode()).hexdigest()[:15], 16)


def feistel(a, b, m, n, tag):
    for i in range(1, pii.ROUNDS + 1):
        a, b = ((a + h(tag, i, b) % m) % m, b) if i % 2 else (a, (b + h(tag, i, a) % n) % n)
    return a, b


def brute_digits(d, tag):
    k = len(d) // 2
    a, b = feistel(int(d[:k]), int(d[k:]), 10**k, 10 ** (len(d) - k), tag)
    return f"{a:0{k}d}{b:0{len(d) - k}d}"


def brute_letters(text, tag):
    k = (len(text) + 1) // 2
    halves = [text[:k], text[k:]]
    for i in range(1, pii.ROUNDS + 1):
        mine = 1 - i % 2
        digest, out = hashlib.sha256(halves[1 - mine].encode()).hexdigest(), ""
        for at, c in enumerate(halves[mine]):
            base, size = next(((b, n) for b, n, low, high in ((97, 26, "a", "z"), (65, 26, "A", "Z"), (48, 10, "0", "9")) if low <= c <= high), (None, 0))
            out += c if base is None else chr(base + (ord(c) - base + h(tag, i, f"{at}|{digest}") % size) % size)
        halves[mine] = out
    return "".join(halves)


def brute_card(digits):
    payload = brute_digits(digits[:-1], "card")
    return next(payload + c for c in "0123456789" if luhn(payload + c))


def brute_ssn(value):
    area, group, serial = map(int, value.split("-"))
    a, b = feistel((area - 1 - (area > 666)) * 99 + group - 1, serial - 1, 898 * 99, 9_999, "ssn")
    areas = [x for x in range(1, 900) if x != 666]
    return f"{areas[a // 99]:03d}-{a % 99 + 1:02d}-{b + 1:04d}"


def brute_ip(value):
    o = list(map(int, value.split(".")))
    a, b = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65_536, 65_536, "ip")
    return ".".join(str(x) for y in (a, b) for x in divmod(y, 256))


def brute_day(value):
    number = (dt.date.fromisoformat(value) - dt.date(1900, 1, 1)).days
    a, b = feistel(*divmod(number, 4_297), 17, 4_297, "date")
    return (dt.date(1900, 1, 1) + dt.timedelta(days=a * 4_297 + b)).isoformat()


def test_pseudonyms_against_brute_force(spark):
    rng = random.Random(4)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    made = []
    for _ in range(40):
        payload = digits(rng.randrange(12, 19))
        card = next(payload + c for c in "0123456789" if luhn(payload + c))
        local, secret = "".join(rng.choice("abXY9._+") for _ in range(rng.randrange(1, 30))), "".join(rng.choice("abXY09+/_=-") for _ in range(rng.randrange(8, 60)))
        local, secret = f"q{local}", f"s{secret}"
        ssn = f"{rng.choice([x for x in range(1, 900) if x != 666]):03d}-{rng.randrange(1, 100):02d}-{rng.randrange(1, 10_000):04d}"
        ip = ".".join(str(rng.randrange(256)) for _ in range(4))
        day = (dt.date(1900, 1, 1) + dt.timedelta(days=rng.randrange(73_049))).isoformat()
        phone = f"({digits(3)}) {digits(3)}-{digits(4)}"
        national = brute_digits(re.sub(r"\D", "", phone), "phone")
        made += [
            ("card", card, brute_card(card)), ("email", f"{local}@mail.example.org", brute_letters(local, "email") + "@mail.example.org"), ("secret", f"api_key: '{secret}", "api_key: '" + brute_letters(secret, "secret")),
            ("ssn", ssn, brute_ssn(ssn)), ("ip", ip, brute_ip(ip)), ("date", day, brute_day(day)), ("phone", phone, f"({national[:3]}) {national[3:6]}-{national[6:]}"),
        ]
    rows = spark.createDataFrame([(i, f"so {text} , {made[i - 1][1]} ;") for i, (_, text, _) in enumerate(made)], "doc_id long, text string")
    found = pii.pseudonymise(rows, KEY).orderBy("doc_id").collect()
    assert [(r.text, r.found) for r in found] == [(f"so {new} , {made[i - 1][2]} ;", [kind, made[i - 1][0]]) for i, (kind, _, new) in enumerate(made)]
    back = pii.restore(spark.createDataFrame([(r.doc_id, r.text) for r in found], "doc_id long, text string"), KEY).orderBy("doc_id").collect()
    assert [r.text for r in back] == [r.text for r in rows.orderBy("doc_id").collect()]


def test_restore_gives_every_form_back(spark):
    rng = random.Random(6)
    days = [dt.date(1900, 1, 1) + dt.timedelta(days=rng.randrange(73_049)) for _ in range(300)]
    texts = [f"{d.day}.{d.month}.{d.year} {d.day:02d}.{d.month:02d}.{d.year} {d.month}/{d.day}/{d.year} {d.day}/{d.month}/{d.year} {d.month:02d}/{d.day:02d}/{d.year} {d.day:02d}/{d.month}/{d.year}, {d}" for d in days]
    texts += ["DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432", "+4915112345678 +1 (743) 555-3824 743-555-3824", "TOKEN\n=\n" + "ab12" * 500, "10.0.0.1 255.255.255.255", "a@b.co x.y-z@sub.example.com."]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    there = pii.pseudonymise(rows, KEY).orderBy("doc_id").collect()
    assert all(r.text != t and len(r.found) >= 1 for r, t in zip(there, texts, strict=True))
    back = pii.restore(spark.createDataFrame([(r.doc_id, r.text) for r in there], "doc_id long, text string"), KEY).orderBy("doc_id").collect()
    assert [r.text for r in back] == texts and [r.found for r in back] == [r.found for r in there]


def test_very_long_texts(spark):
    """A megabyte of letters, of base64, of labels; all in linear time and without deep recursion."""
    rng = random.Random(9)
    texts = ["a" * 1_000_000, "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", k=1_000_000)), "a@" + "b." * 20_000 + "!", "a." * 300_000 + "@x", "1-" * 300_000, "token" + " " * 500_000 + "x", "x@y " * 100_000, "q" * 70 + "@example.com"]
    found = pseudonyms(spark, texts)
    assert [r.text for k, r in enumerate(found) if k != 2] == [t for k, t in enumerate(texts) if k != 2]


def test_the_key_comes_from_the_session(spark):
    spark.conf.unset(pii.KEY_SETTING)
    made = pii.configured_key(spark)
    assert len(made) == 64 and pii.configured_key(spark) == made
    spark.conf.set(pii.KEY_SETTING, "own")
    assert pii.configured_key(spark) == "own"
    spark.conf.unset(pii.KEY_SETTING)
