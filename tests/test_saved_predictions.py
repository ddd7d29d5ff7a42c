"""Saved predictions from files by hand."""

from augury.operators import checks
from augury.sources import ingest


def test_every_row_of_every_file_gets_a_reason(spark, tmp_path):
    (tmp_path / "j").mkdir()
    (tmp_path / "c").mkdir()
    (tmp_path / "j" / "a.json").write_text("""[
 {"game_id": 1, "sport": "soccer", "model": "m", "seed": 1, "outcome": 0, "probabilities": [0.5, 0.3, 0.2], "note": "x"},
 {"game_id": 2, "sport": "baseball", "model": "m", "seed": 1, "outcome": 2, "probabilities": [0.5, 0.1, 0.4]},
 {"game_id": 3, "sport": "soccer", "model": "m", "seed": 1, "outcome": 1, "probabilities": [0.5, 0.5]},
 {"game_id": 4, "sport": "soccer", "model": "m", "seed": 1, "outcome": 7, "probabilities": [0.5, 0.3, 0.2]},
 {"game_id": null, "sport": "soccer", "model": "m", "seed": 1, "outcome": 1, "probabilities": [0.5, 0.3, 0.2]}]""")
    (tmp_path / "j" / "b.json").write_text("not json at all")
    (tmp_path / "c" / "a.csv").write_text(
        'game_id,sport,model,seed,outcome,p_home,p_draw,p_away\n1,soccer,m2,1,1,0.5,0.3,0.2\n5,soccer,"two\nlines",1,1,0.5,0.3,0.2\n'
        "6,soccer,m,1,,0.5,0.3,0.2\n7,soccer,m,1,1,0.5,nan,0.2\n8,soccer,m,1,1,0.5,0.3,0.2\n8,soccer,m,1,1,0.5,0.3,0.2\n")
    found = ingest.saved_predictions(spark, str(tmp_path / "j"), str(tmp_path / "c"))
    rows = checks.saved_prediction_rows(found).collect()
    got = sorted((r["game_id"] or 0, r["model"] or "", r["reason"] or "valid") for r in rows)
    assert got == sorted([
        (1, "m", "outcome_disagrees"), (1, "m2", "outcome_disagrees"), (2, "m", "probabilities"), (3, "m", "non_finite"),
        (4, "m", "outcome"), (0, "m", "missing_field"), (0, "", "missing_field"), (5, "two\nlines", "valid"), (6, "m", "no_outcome"),
        (7, "m", "non_finite"), (8, "m", "duplicate"), (8, "m", "duplicate")])
