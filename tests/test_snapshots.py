from datetime import datetime

from quarrylight.operators.snapshots import file_changes

T = datetime(2025, 1, 1)
FILES = "generation_id int, repository_id string, path string, content_hash string, text string, captured_at timestamp_ntz, snapshot string"
GENS = "generation_id int, repository_id string, state string"


def test_changes(spark):
    files = [
        (1, "r", "a/b.py", "AA", "x", T, None),
        (1, "r", ".\\gone.py", "BB", "y", T, None),
        (1, "r", "same.py", None, "abc", T, None),
        (3, "r", "./a//b.py", "sha256:ab", "z", T, None),
        (3, "r", "a/b.py", "aa", "z", datetime(2024, 1, 1), None),
        (3, "r", "café.py", "cc", "n", T, None),
        (3, "r", "same.py", "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad", None, T, None),
        (3, "r", "same.py", "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad", None, T, None),
        (2, "r", "noise.py", "dd", "n", T, None),
        (9, "r", "café.py", "cc", "n", T, None),
    ]
    gens = [(1, "r", "complete"), (2, "r", "abandoned"), (3, "r", "active"), (5, "r", "complete"), (9, "r", "complete"), (4, "q", "complete")]
    got = {tuple(x) for x in file_changes(spark.createDataFrame(files, FILES), spark.createDataFrame(gens, GENS)).collect()}
    assert got == {
        (3, "a/b.py", "changed"),
        (3, "gone.py", "removed"),
        (3, "café.py", "added"),
        (5, "a/b.py", "removed"),
        (5, "café.py", "removed"),
        (5, "same.py", "removed"),
        (9, "café.py", "added"),
    }


def test_empty(spark):
    assert file_changes(spark.createDataFrame([], FILES), spark.createDataFrame([], GENS)).count() == 0
