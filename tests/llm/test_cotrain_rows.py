"""Co-training reads its rows through the function that the FTRL fit takes."""
import numpy as np

from srcgraph.llm.cotrain import co_train, meta_features, text_features


def test_co_train_fits_both_views():
    good, bad = "The long quiet sentence, as it stands in a book.", "$$$ #### |||| 1111"
    rows = [(text_features(t), meta_features(s, "en", len(t))) for t, s in [(good, "a"), (bad, "b")] * 8]
    y = np.array([1, 0] * 8)
    model = co_train(rows, y, [(text_features(good), meta_features("a", "en", 50))] * 3)
    assert model.scores(good, "a", "en", len(good))[2] > 0.5 > model.scores(bad, "b", "en", len(bad))[2]
