"""Connected components and intermediate tables, for the operators of this package."""

from __future__ import annotations

from factloom.operators.components import components
from factloom.operators.shared import Tables, shared_folder, written

__all__ = ["Tables", "components", "shared_folder", "written"]
