from tidelog.llm import toxicity
from tidelog.llm.toxicity import Scorer


def test_words_beyond_the_cache_inside_one_text(monkeypatch):
    entries = {"stupid": 3.0, "blorkish": 2.0}, {"idiot": 4.0}
    text = 'stupid one two blorkish three idiotic "stuppid four" said stupid five six seven stupid'
    want = Scorer(*entries).features(text)
    for size in (1, 2, 3, 5):
        monkeypatch.setattr(toxicity, "CACHED_WORDS", size)
        scorer = Scorer(*entries)
        assert scorer.features(text) == want and scorer.features(text) == want and len(scorer.known) <= size
