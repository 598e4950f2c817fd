"""Scoring of profiles as they arrive."""

from profilerank.streaming.board import (
    newest_records, read_board, read_newest_board, score_stream, start_board, start_newest_board, start_scores,
)

__all__ = [
    "newest_records", "read_board", "read_newest_board", "score_stream", "start_board", "start_newest_board", "start_scores",
]
