"""Import every module that registers queries."""

import workload.scans  # noqa: F401
import workload.windows  # noqa: F401
import workload.facts  # noqa: F401
import workload.upkeep  # noqa: F401
import workload.streams  # noqa: F401
