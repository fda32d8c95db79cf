"""Exploratory data analysis of large tables on Spark.

Operators take a DataFrame and return a DataFrame; fits return a small object
that applies itself to a DataFrame.
"""

from .operators.cleaning import (drop_duplicates, drop_sparse_columns, dropna_rows, impute,
                                 missing_share)
from .operators.clusters import cluster_projection, kmeans, pca, silhouette
from .operators.describe import (column_spread, describe_datetime, describe_numeric, mean_median,
                                 summary_statistics)
from .operators.expectations import validate
from .operators.features import (label_codes, label_encode, onehot_encode, onehot_sparse,
                                 standardize)
from .operators.frequency import (column_modes, describe_categorical, top_values, unique_counts,
                                  value_counts)
from .operators.information import neighbour_information
from .operators.outliers import outlier_values, outliers
from .operators.plotdata import (boxplot, boxplot_by_category, boxplot_grid, count_plot,
                                 histogram, pair_plot, scatter, scatter_matrix)
from .operators.profile import (data_bytes, dataset_overview, duplicate_count, identify_types,
                                missing_profile, overview, quality_profile)
from .operators.quantiles import column_quantiles, group_quantiles
from .operators.relations import (correlation_heatmap, correlations, linear_regression,
                                  mutual_information, pearson, spearman, strong_relationships)
from .plans.report import narrative, recommend_analyses, report_html, summary_report
from .plans.workflow import Run, analyse
from .sources.nested import (auto_normalize, flatten, normalize_json, normalize_xml, scan_json,
                             scan_xml)
from .sources.tables import export_results, load, read_results, scan_csv
from .sources.workbooks import scan_workbooks, workbook_rows

__all__ = [name for name in dir() if not name.startswith("_")]
