"""Shapes of long unbroken words."""

from careerloom.llm import quality


def shape_of(word):
    return quality._Codes()[word] & 0x7FFFFFFF


def test_shape_covers_the_whole_word():
    assert shape_of(b"aB" * 128 + b"1") != shape_of(b"aB" * 128 + b"-")
    assert shape_of(b"a" * 5000 + b"7" * 5000) == shape_of(b"x0") != shape_of(b"x")
    assert shape_of(b"") == shape_of(b"")
