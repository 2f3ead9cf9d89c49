"""Import every module that registers queries of this folder."""

import tidemark.llm.lengths  # noqa: F401
import tidemark.llm.packing  # noqa: F401
import tidemark.llm.keyed  # noqa: F401
import tidemark.llm.decontaminate  # noqa: F401
import tidemark.llm.outliers  # noqa: F401
import tidemark.llm.toxicity  # noqa: F401
import tidemark.llm.suffixes  # noqa: F401
import tidemark.llm.similar  # noqa: F401
import tidemark.llm.main_text  # noqa: F401
import tidemark.llm.revisits  # noqa: F401
import tidemark.llm.recipes  # noqa: F401
import tidemark.llm.bitsliced  # noqa: F401
import tidemark.llm.spelling  # noqa: F401
