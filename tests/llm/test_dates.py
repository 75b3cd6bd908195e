import re

import pytest

from harrow.llm import pii

SPELLINGS = [
    "2021-03-04T10:00:00Z", "2021-03-04T10:00", "2021-03-04 10:00", "3/14/2020", "03/4/2020", "14/3/2020", "2021-3-4", "2021/12/4", "1.2.2003", "31.1.2003", "14 March 2020", "4 March 2020", "04 March 2020",
    "14 March, 2020", "14th March 2020", "1st of May 1999", "March 14th, 2020", "March 22nd 2020", "MARCH 3RD, 2020", "march 3, 2020", "Sept 4, 2020", "Sept. 14, 2020", "4 Sept 2020", "Mar 3, 2021", "Mar. 13, 2021",
    "14-Mar-2020", "10/Oct/2000:13:55:36", "May 3, 2021", "3 may 2021",
]


def shape(text):
    """The format of a date: digits as 0, names by their kind and case."""
    text = re.sub(r"(?<=\d)(st|nd|rd|th)", "th", re.sub(r"(?<=\d)(ST|ND|RD|TH)", "TH", text))
    name = lambda m: m[0] if m[0].title() == "Sept" else "m" * 3 if len(m[0]) == 3 and m[0].title() != "May" else "M"
    return re.sub(r"\d", "0", re.sub(rf"(?i:{'|'.join(pii.MONTHS)}|\b(?:sept|{'|'.join(x[:3] for x in pii.MONTHS)})\b)", name, text))


@pytest.mark.parametrize("value", SPELLINGS)
def test_every_spelling_is_permuted_in_its_format(value):
    for key in (b"k%d" % i for i in range(40)):
        text = f"before {value} after {value}."
        new, found = pii.pseudonyms(text, key)
        assert found == {"date": 2} and shape(new) == shape(text)
        assert pii.pseudonyms(new, key)[1] == found and pii.pseudonyms(new, key, back=True)[0] == text
    assert pii.pseudonyms(text, b"k")[0] != text


def test_equal_dates_are_linked_across_spellings():
    for y, m, d in ((2021, 3, 4), (1999, 12, 31), (2000, 2, 29), (1900, 1, 1), (2099, 12, 31)):
        name = pii.MONTHS[m - 1]
        new = pii.pseudonyms(f"{y}-{m}-{d} {y}-{m:02d}-{d:02d}T10:00 {m}/{d}/{y} {m:02d}/{d:02d}/{y} {d}.{m}.{y} {d} {name} {y} {name} {d:02d}, {y}", b"key")[0]
        y, m, d = map(int, new.split(" ")[0].split("-"))
        name = pii.MONTHS[m - 1]
        assert new == f"{y}-{m}-{d} {y}-{m:02d}-{d:02d}T10:00 {m}/{d}/{y} {m:02d}/{d:02d}/{y} {d}.{m}.{y} {d} {name} {y} {name} {d:02d}, {y}"


def test_different_dates_stay_different():
    texts = [f"{d}/{m}/{y}" for y in (1999, 2000) for m in range(1, 13) for d in range(1, 32)]
    new = [pii.pseudonyms(t, b"key")[0] for t in texts]
    assert len(set(new)) == len(texts) and [pii.pseudonyms(t, b"key", back=True)[0] for t in new] == texts


def test_what_is_no_date_stays():
    for t in ("2021-3-32", "13/32/2020", "31 February 2020", "0 March 2020", "March 14rd, 2020", "2021-3-4-5", "1.2.2003.4", "v2021.3.4", "March 2020", "14 Marching 2020", "2021-03-04Tx", "3/14/1850"):
        assert pii.pseudonyms(t, b"k") == (t, {})
