"""Words are counted outside Python as text.split() would."""

import sys
from collections import Counter

import pyarrow as pa

from remeasure.llm import sentences


def test_words_of_a_column_are_counted_like_split():
    blanks = [chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace()]
    texts = ["", None, "  Ja. Nein. Ja.  ", "​ x​y", *[f"a{b}b{b}{b}a" for b in blanks], *[f"{b}a{b}" for b in blanks]]
    counts = sentences.Counts()
    for k in range(0, len(texts), 7):
        counts.add_words(pa.array(texts[k : k + 7], pa.string()))
    counts.count_words()
    assert counts.tokens == Counter(w for t in texts if t for w in t.split())
