"""Operators on coordinate tables (row_id, col_id, amount), with an `iteration` column where values vary."""
