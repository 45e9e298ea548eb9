"""Feature preparation, folds, candidate models, selection and scoring."""

from tablewright.modeling.candidates import CLASSIFICATION, REGRESSION, Settings, pool_of
from tablewright.modeling.features import (
    class_count, decode_labels, feature_names, feature_pipeline, feature_set, fit_features, label_codes, prune_features,
    target_classes, target_vocabulary,
)
from tablewright.modeling.folds import kfold, stratified_kfold, stratified_train_test, train_test
from tablewright.modeling.metrics import classification_metrics, confusion, regression_metrics, roc_auc
from tablewright.modeling.neighbors import knn_classify, knn_regress, nearest_neighbors
from tablewright.modeling.selection import TrainedModel, compare_models, fit_model, prepare_problem, train_best

__all__ = [
    "CLASSIFICATION", "REGRESSION", "Settings", "TrainedModel", "class_count", "classification_metrics", "compare_models",
    "confusion", "decode_labels", "feature_names", "feature_pipeline", "feature_set", "fit_features", "fit_model", "kfold",
    "knn_classify", "knn_regress", "label_codes", "nearest_neighbors", "pool_of", "prepare_problem", "prune_features",
    "regression_metrics", "roc_auc", "stratified_kfold", "stratified_train_test", "target_classes",
    "target_vocabulary", "train_best", "train_test",
]
