"""Connected components, for the training-data operators."""

from ..graph import components  # noqa: F401
