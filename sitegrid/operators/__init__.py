"""DataFrame to DataFrame operators over tracks in long form: (sample, row_id, value columns)."""
