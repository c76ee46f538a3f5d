"""Words of plain letters are coded as one text, also with sharp s, and give the ids of the vocabulary itself."""

import numpy as np

from intelspark.llm import packing


def test_words_with_sharp_s_are_coded_together():
    words = packing.WordIds(packing.VOCABULARY)
    assert words._joined(["straße", "le", "çà"]) is not None


def test_ids_are_those_of_the_vocabulary():
    words = packing.WordIds(packing.VOCABULARY)
    given = ["Straße", "ÀÉ.", "the***", "a,%%%", "x.'", "don't", "it's'", "12a", "ÿ\"]", "Þ{}", "=", "a-b", "×", "ẞ"]
    got = [np.frombuffer(raw, np.int32).tolist() for raw in words.ids(given)]
    assert got == [words.tokenizer.encode(w, add_special_tokens=False).ids for w in given]
