"""Texts and helpers that the tests of this folder share."""

import re

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, lower=True):
    text = text or ""
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER) if lower else text)


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, "One  TWO"), (7, "é ü 😀 <|im_end|>\x00 x"), (8, "word " * 30000), (9, "x" * 50000),
       (10, "a b c d e f g\nh i j k"), (10, "a b c d e f g\nh i j k"), (11, "a b c d e f g\nh i j k"), (None, "a b c d e f g\nh i j k"), (None, None), (12, "A\r\nB\u00a0C\u3000D\x85E")]
