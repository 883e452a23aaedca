"""What the follower's source reads between two looks at a file."""

import gzip

from tributary.sources.datasource import poll
from tributary.sources.walk import walk

LINE = "2026-08-13 14:00:{:02d}.000 [m] ERROR a.B - m{}\n"


def look(path, state):
    rows, after = poll(walk(str(path)).files[0], state, 0, None, "UTC")
    return [(r["rec_no"], r["line_no"], r["message"]) for r in rows], after


def test_growth_in_pieces(tmp_path):
    path = tmp_path / "a.log"
    path.write_text(LINE.format(0, 0) + LINE.format(1, 1))
    rows, state = look(path, None)
    assert rows == [(1, 1, "m0")]  # the last record may go on
    with open(path, "a") as f:
        f.write("\tat x\n\tat y")
    rows, state = look(path, state)
    assert rows == []
    with open(path, "a") as f:
        f.write("z\n" + LINE.format(2, 2))
    rows, state = look(path, state)
    assert rows == [(2, 2, "m1\n\tat x\n\tat yz")]
    rows, state = look(path, state)  # nothing new: what is there is whole
    assert rows == [(3, 5, "m2")]
    assert look(path, state)[0] == []


def test_rewritten_and_shrunk_files_start_again(tmp_path):
    path = tmp_path / "a.log"
    path.write_text("".join(LINE.format(n, n) for n in range(5)))
    _, state = look(path, None)
    _, state = look(path, state)
    path.write_text("".join(LINE.format(n, n + 50) for n in range(3)))
    rows, state = look(path, state)
    assert [r[2] for r in rows] == ["m50", "m51"]
    path.write_text(LINE.format(9, 99))
    rows, state = look(path, state)
    assert [r[2] for r in rows + look(path, state)[0]] == ["m99"]


def test_compressed_files_are_read_once_and_whole(tmp_path):
    path = tmp_path / "a.log.gz"
    path.write_bytes(gzip.compress("".join(LINE.format(n, n) for n in range(3)).encode()))
    assert [r[2] for r in look(path, None)[0]] == ["m0", "m1", "m2"]


def test_empty_and_partial_lines(tmp_path):
    path = tmp_path / "a.log"
    path.write_text("no line end yet")
    rows, state = look(path, None)
    assert rows == []
    rows, state = look(path, state)  # it does not grow any more
    assert [r[2] for r in rows] == ["no line end yet"]


def test_bounded_looks_read_everything_once(tmp_path):
    path = tmp_path / "a.log"
    path.write_text("".join(LINE.format(n, n) + ("\tat somewhere in the code\n" * 40 if n == 5 else "") for n in range(20)))
    state, seen, looks = None, [], 0
    while not state or not state["still"]:
        rows, state = poll(walk(str(path)).files[0], state, 0, None, "UTC", most=100)
        seen += [(r["rec_no"], r["message"].split("\n")[0]) for r in rows]
        looks += 1
    assert seen == [(n + 1, f"m{n}") for n in range(20)] and looks > 8
