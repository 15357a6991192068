"""Every relational query against its DuckDB oracle."""

import pytest

from quillon.plans import registry

from .conftest import DATA, rows


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_oracle(spark, duck, name):
    got = registry.QUERIES[name](spark, f"{DATA}/sf0.001").toPandas()
    expected = duck.execute(registry.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    assert rows(got, columns) == rows(expected, columns)


def test_game_trace_against_loop(spark):
    import duckdb

    got = {(r.user_id, r.day): (r.valid, r.label) for r in registry.QUERIES["r63_game_trace"](spark, f"{DATA}/sf0.001").collect()}
    events = duckdb.sql(f"SELECT user_id, strftime(ts, '%Y-%m-%d'), event_id, event_type FROM '{DATA}/sf0.001/events.parquet' ORDER BY ts, event_id").fetchall()
    games = {}
    for user, day, number, kind in events:
        games.setdefault((user, day), []).append((number % 9, "O" if kind in ("view", "click") else "X"))
    assert set(got) == set(games)
    for key, moves in games.items():
        assert got[key] == play(moves)


def play(moves):
    from quillon.operators.grading import LINES

    board, last, winner, good = {}, None, "", True
    for cell, mark in moves:
        good = good and not winner and cell not in board and mark != last
        board[cell] = board.get(cell, "") + mark
        last = mark
        if any(all(mark in board.get(c, "") for c in line) for line in LINES):
            winner = mark
    return good, f"won by {winner}" if winner else "draw" if len(moves) == 9 else "in play"
