"""Scalar functions: every public function takes and returns ``Column`` objects."""
