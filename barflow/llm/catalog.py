"""All queries of the subpackage with the SQL each is compared with."""
from barflow.llm import bytebpe, counts, exact, fingerprints, near, packing, periodic, quality, repair, templates, toxicity, transcripts, urls  # noqa: F401
from barflow.llm.common import ORACLES, QUERIES  # noqa: F401
