"""tablelens — exploratory data analysis and preparation as lazy Spark plans.

Every operator takes a DataFrame and returns a DataFrame. Submodules:
``sources`` (ingest/export), ``operators`` (profile, impute, convert, scale,
dedupe, charts, tests), ``functions`` (native normal-distribution
expressions, p-value kernels), ``plans`` (distributed rank and bounded-fit
helpers), ``streaming`` (fitted transforms on streams).
"""

from .operators.charts import (box_stats, correlation_matrix, density_histogram, distribution_summary,
                               grouped_box, grouped_mean, histogram, kde, normal_curve, qq_points,
                               scatter_points, strip_points, value_counts, value_shares)
from .operators.columns import (column_roles, drop_missing, nan_to_null, preview, round_floats,
                                schema_report, search_columns, select_rows, to_numeric)
from .operators.convert import convert
from .operators.dedupe import dedupe, dedupe_report
from .operators.htests import chi2, contingency, ks_normal, pearson, shapiro, spearman, t_test
from .operators.impute import fit_imputer, impute, impute_preview, impute_report, validate_plan
from .operators.knn import knn_impute
from .operators.profile import (describe_categorical, describe_numeric, duplicate_count, missing_report,
                                mode_report)
from .operators.scale import fit_scaler, normalize, normalize_report
from .sources.delimited import infer_types, ingest, read_csv, read_txt
from .sources.export import export_csv

__all__ = [n for n in dir() if not n.startswith("_")]
