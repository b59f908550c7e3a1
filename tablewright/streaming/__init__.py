"""Row-local cleaning of files that keep arriving in a landing folder."""
