"""Part of kinfold; see the package docstring."""
