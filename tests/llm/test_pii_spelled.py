import time

import pytest

from invoicelake.llm import pii


@pytest.mark.parametrize(
    "text,kind,found",
    [
        ("call +1 five five five 867 5309 now", "phone", "+1 five five five 867 5309"), ("plus one 555 123 4567", "phone", "plus one 555 123 4567"),
        ("at one dot one dot one dot one, ok", "ip", "one dot one dot one dot one"), ("at 192 dot 168 dot 1 dot 10 dot", "ip", "192 dot 168 dot 1 dot 10"),
        ("ring four four two zero seven nine four six zero nine five eight", "phone", "four four two zero seven nine four six zero nine five eight"),
        ("card 4539 five seven eight seven 6362 1486", "card", "4539 five seven eight seven 6362 1486"), ("plus 1 double 5 five 867 5309", "phone", "plus 1 double 5 five 867 5309"),
        ("bob at 1000 dot com", "email", "bob at 1000 dot com"), ("one two three four at 12345 dot com", "email", "four at 12345 dot com"),
    ],
)
def test_mixed_runs(text, kind, found):
    spans = [(s["kind"], text[s["start"] : s["end"]], s["plain"]) for s in pii.spans_of(text)]
    if kind == "email":
        assert any(k == kind and found.split(" at ")[1] in x for k, x, _ in spans)
    else:
        assert spans == [(kind, found, False)]


@pytest.mark.parametrize("text", ["one, 2, 3, 4, 5, 6, 7, 8, 9, 10", "un point 1998, 2004, 2010 plus un", "3 plus 4 dot 5", "version 1 point 2 point 3", "in 1998 one of 2,000", "five 1000 point"])
def test_numbers_in_prose_stay(text):
    assert pii.spans_of(text) == []


LONG = "longlocalpart." * 5 + "x"


@pytest.mark.parametrize(
    "text,kind,found",
    [
        ("plus one five five five\nfour two two\nzero seven nine", "phone", "plus one five five five\nfour two two\nzero seven nine"),
        ("plus\tone\tfive\tfive\tfive\tfour\ttwo\ttwo\tzero\tnine", "phone", "plus\tone\tfive\tfive\tfive\tfour\ttwo\ttwo\tzero\tnine"),
        ("plus one five five / five four two    two zero nine", "phone", "plus one five five / five four two    two zero nine"),
        ("joe\tat\texample\tdot\tcom", "email", "joe\tat\texample\tdot\tcom"), ("joe  at  example  dot  com", "email", "joe  at  example  dot  com"),
        ("joe\nat\nexample\r\ndot\ncom", "email", "joe\nat\nexample\r\ndot\ncom"), ("joe‎@example.com", "email", "joe‎@example.com"), ("joe@exam⁦ple️.com", "email", "joe@exam⁦ple️.com"),
        (f"to {LONG} at example dot com", "email", f"{LONG} at example dot com"),
        ("x at a dot b dot c dot d dot e dot f dot g dot org", "email", "x at a dot b dot c dot d dot e dot f dot g dot org"),
        ("a dot b dot c dot d dot e dot f at example dot com", "email", "a dot b dot c dot d dot e dot f at example dot com"),
        ("usuario arroba dominio punto es", "email", "usuario arroba dominio punto es"), ("jean arobase exemple point fr", "email", "jean arobase exemple point fr"),
        ("hans at beispiel punkt de", "email", "hans at beispiel punkt de"), ("hans     [ at ]     beispiel    (punkt)    de", "email", "hans     [ at ]     beispiel    (punkt)    de"),
        ("joe_at_my-example-dot-com", "email", "joe_at_my-example-dot-com"), ("joe @ example . com. Then", "email", "joe @ example . com"), ("joe at example dot com. Then", "email", "joe at example dot com"),
        ("joe @ example.co.uk", "email", "joe @ example.co.uk"), ("card 4539    5787   6362 l486", "card", None),
    ],
)
def test_any_white_space_and_length(text, kind, found):
    spans = [(s["kind"], text[s["start"] : s["end"]]) for s in pii.spans_of(text)]
    assert spans == ([(kind, found)] if found else [])
    base = pii.plain(text)
    assert pii.disguised(text, base) == pii.disguised(text, base, gated=False)


@pytest.mark.parametrize("text", ["we arrive at this point in time", "look at example.com now", "a punto de llover", "at\n\ndot\n\nat", "he looked at\nthe end. Then", "five\n\none\n\ntwo", "see (at) all", "x @ y"])
def test_prose_with_such_words_stays(text):
    assert pii.spans_of(text) == []


@pytest.mark.parametrize("text", ["a dot " * 60_000, "a at b dot 1 " * 30_000, " " * 400_000 + "@", "( " * 200_000, "one\n" * 100_000, "at " * 100_000, "@ a . " * 60_000, "1" + " " * 300_000 + "O", "a@" * 100_000])
def test_long_texts_take_linear_time(text):
    began = time.perf_counter()
    pii.spans_of(text)
    assert time.perf_counter() - began < 10
