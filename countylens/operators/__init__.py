"""DataFrame to DataFrame steps: lazy, no collect, usable with ``.transform``."""
