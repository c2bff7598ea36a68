"""See the README for the operators of this subpackage."""
