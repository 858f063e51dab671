"""Values of personal formats next to other text, and permutations without fixed points."""

import datetime
import re

from verity.llm import pseudonyms

KEY = b"a key"


def digits(value):
    return re.sub(r"\D", "", value)


def kinds(text):
    new, spans = pseudonyms.Pseudonyms(KEY).replaced(text)
    return new, [(k, new[a:b]) for k, a, b in spans]


def test_cards_next_to_other_digits():
    alone = kinds("4111 1111 1111 1111")[1][0][1]
    for before, after in (("", " 12/26"), ("", " 123"), ("", " 1226 123"), ("123 ", ""), ("2024 ", " 12/26"), ("1 2 3 ", " 99"), ("", " 2024-05-01T10:00")):
        new, found = kinds(f"card {before}4111 1111 1111 1111{after}.")
        assert ("card", alone) in found and "4111 1111" not in new, (before, after, new)
    for number in ("378282246310005", "30569309025904", "6011 1111 1111 1117", "4222222222222", "5555-5555-5555-4444"):
        new, found = kinds(f"{number} 12/26")
        assert [k for k, _ in found] == ["card"] and number not in new and new.endswith(" 12/26")
        assert pseudonyms.check_digit(digits(found[0][1])[:-1]) == digits(found[0][1])[-1]
    long = "1 " * 20_000
    assert kinds(long)[0].count(" ") == 20_000


def test_dates_before_a_time_and_year_first():
    for text in ("at 2024-05-01T12:00:00Z.", "at 2024-05-01t12:00.", "on 2024/05/01,", "on 2024.05.01,", "on 2024/5/1,"):
        new, found = kinds(text)
        assert [k for k, _ in found] == ["date"] and found[0][1] not in text, text
        datetime.date(*map(int, re.split("[-/.]", found[0][1])))
    assert kinds("at 2024-05-01T12:00:00Z.")[0].endswith("T12:00:00Z.")


def test_ibans_keep_country_and_check():
    for iban in ("DE89 3704 0044 0532 0130 00", "GB29NWBK60161331926819", "fr14 2004 1010 0505 0001 3m02 606", "NO9386011117947"):
        new, found = kinds(f"to {iban} BIC ABCDEF12")
        assert [k for k, _ in found] == ["iban"] and iban not in new and new.endswith(" BIC ABCDEF12")
        code = found[0][1].replace(" ", "").upper()
        assert code[:2] == iban[:2].upper() and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1
        assert [c.isspace() for c in found[0][1]] == [c.isspace() for c in iban]
    assert kinds("DE89 3704 0044 0532 0130 00")[1][0][1].replace(" ", "") == kinds("DE89370400440532013000")[1][0][1]
    assert kinds("DE88 3704 1044 0532 0130 00")[1] == [] and kinds("AB12 this is no account at all")[1] == []


def test_social_security_numbers():
    new, found = kinds("SSN 123-45-6789, 123 45 6789; not 000-12-3456, 666-12-3456, 900-12-3456, 123-00-4567.")
    assert [k for k, _ in found] == ["ssn", "ssn"] and digits(found[0][1]) == digits(found[1][1]) != "123456789"
    assert "000-12-3456, 666-12-3456, 900-12-3456, 123-00-4567." in new


def test_telephone_numbers_without_plus():
    linked = {digits(v)[-10:] for text in ("(743) 555-3824", "743-555-3824", "743.555.3824", "+1 743 555 3824", "001 743 555 3824") for k, v in kinds(f"call {text}!")[1] if k == "phone"}
    assert len(linked) == 1 and linked != {"7435553824"}
    new, found = kinds("+1 743 555 3824 4111 1111 1111 1111")
    assert [k for k, _ in found] == ["phone", "card"]
    assert [k for k, _ in kinds("+4111111111111111")[1]] == ["card"]


def test_no_value_stays_as_it_is():
    for size in (2, 3, 10, 26, 97, 1000, 73049):
        p = pseudonyms.Permutation(KEY, size, "t")
        images = [p(x) for x in range(size)]
        assert len(set(images)) == size and all(x != y for x, y in enumerate(images))
        assert all(p.invert(y) == x for x, y in enumerate(images[:500]))
    names = pseudonyms.Pseudonyms(KEY)
    days = [(datetime.date(1900, 1, 1) + datetime.timedelta(d)).isoformat() for d in range(0, 73049)]
    assert all(names.replaced(d)[0] != d for d in days)
    letters = [f"{c}@x.org" for c in "abcdefghijklmnopqrstuvwxyz"]
    assert all(names.replaced(a)[0] != a for a in letters) and len({names.replaced(a)[0] for a in letters}) == 26


def test_addresses_of_one_shape_stay_apart():
    names = pseudonyms.Pseudonyms(KEY)
    shapes = [f"{a}{B}{n}@x.org" for a in "abcdefghij" for B in "KLMNOPQRST" for n in range(10)]
    assert len({names.replaced(s)[0] for s in shapes}) == len(shapes)


def test_equal_telephone_numbers_are_linked():
    for forms in (("+49 30 1234567", "+49301234567", "+49 (0)30 1234567", "0049 30 1234567", "+4930 1234567"), ("+1 743 555 3824", "+17435553824"),
                  ("+358 40 123 4567", "+358401234567"), ("+44 20 7946 0958", "+442079460958")):
        found = [kinds(f"call {f}.")[1] for f in forms]
        assert [[k for k, _ in f] for f in found] == [["phone"]] * len(forms)
        plain = {digits(f[0][1].replace("(0)", "")).removeprefix("00") for f in found}
        assert len(plain) == 1 and digits(forms[0]) not in plain, forms
        code = digits(forms[0].split()[0])
        assert all(p.startswith(code) for p in plain)


def test_one_date_in_five_notations_and_one_address_in_two_cases():
    import datetime
    import re

    from verity.llm.pseudonyms import Pseudonyms

    names = Pseudonyms(b"k")
    new = [names.replaced(t)[0] for t in ("1985-03-24", "1985/3/24", "24.03.1985", "24/03/1985", "03/24/1985", "1985.03.24")]
    days = set()
    for text, order in zip(new, ("ymd", "ymd", "dmy", "dmy", "mdy", "ymd")):
        told = dict(zip(order, map(int, re.split(r"[-/.]", text))))
        days.add(datetime.date(told["y"], told["m"], told["d"]))
    assert len(days) == 1 and datetime.date(1985, 3, 24) not in days
    one, two = (names.replaced(t)[0] for t in ("Anna.Berg7@mail.example.org", "anna.berg7@mail.example.org"))
    assert one != two and one.lower() == two.lower() and one[0].isupper() and one.split("@")[0].lower() != "anna.berg7"
    assert Pseudonyms(b"x" * 64 + b"1").replaced("1985-03-24") != Pseudonyms(b"x" * 64 + b"2").replaced("1985-03-24")
