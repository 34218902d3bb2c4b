"""Functions: Column to Column, and the one-pass HTML parser."""
