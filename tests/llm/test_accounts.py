"""Account numbers and IBANs in the spellings that people use."""

import random

import pytest

from flockmetrics.llm.pii import finder

ACCOUNTS = {
    "Account No: 12345678": "12345678", "Account Number: 12345678": "12345678", "Acct Nr. 99887766": "99887766",
    "ACCOUNT NUM #1234567": "1234567", "account: 12-3456-78": "12-3456-78", "konto 123456789": "123456789",
    "account 12345": None, "account: 2024-01-15": None, "account north 12345678": None, "account 123456789012345678": None,
    "account no 12-34": None,
}
IBANS = {
    "pay DE89370400440532013000 now": "DE89370400440532013000", "pay DE89 3704 0044 0532 0130 00 NOW": "DE89 3704 0044 0532 0130 00",
    "IBAN: GB82 WEST 1234 5698 7654 32": "GB82 WEST 1234 5698 7654 32", "to BE68 5390 0754 7034 THAT IS": "BE68 5390 0754 7034",
    "pay DE88370400440532013000 now": None, "xDE89370400440532013000": None, "DE89370400440532013000x": None, "DE89": None,
    "ÄDE89370400440532013000": None, "DE8": None, "part CD34 CD34 CD34 CD34 CD34 CD34 CD34 CD34 CD34 CD34": None,
}


@pytest.mark.parametrize("kind, cases", [("account", ACCOUNTS), ("iban", IBANS)])
def test_spellings(kind, cases):
    find = finder()
    got = {text: [text[s:e] for k, s, e in find(text) if k == kind] for text in cases}
    assert got == {text: [value] if value else [] for text, value in cases.items()}


def test_long_texts_take_linear_time():
    """A quarter of a million anchors; a quadratic search would not end."""
    text = "DE89370400440532013000 Account No: 12345678 " * 20_000 + "AB12 " + "CD34 " * 90_000
    spans = finder()(text)
    assert sum(k == "iban" for k, _, _ in spans) == sum(k == "account" for k, _, _ in spans) == 20_000


def test_spans_are_in_the_text_and_do_not_overlap():
    rnd, find = random.Random(4), finder()
    for _ in range(3_000):
        text = "".join(rnd.choice(["DE", "89", " ", "3704", "Account", " No. ", "-", "12", "A", "é", "iban"]) for _ in range(40))
        for kind in ("account", "iban"):
            own = [(s, e) for k, s, e in find(text) if k == kind]
            assert all(0 <= s < e <= len(text) for s, e in own)
            assert all(a[1] <= b[0] for a, b in zip(own[:-1], own[1:], strict=True))
