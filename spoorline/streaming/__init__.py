"""The same normalizers and rules over files that keep arriving."""
