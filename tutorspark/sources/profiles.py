"""Mapping profiles, small JSON settings that rename recurring headers."""

from __future__ import annotations

import json
from collections.abc import Mapping

from tutorspark.schema import SESSION, STUDENT


def parse_mapping_profile(text: str) -> dict:
    profile = json.loads(text)
    if not isinstance(profile, dict):
        raise ValueError("a mapping profile must be a JSON object")
    datasets = profile.get("dataset_profiles")
    if not isinstance(datasets, dict):
        raise ValueError("a mapping profile needs an object named dataset_profiles")
    for dataset in (SESSION, STUDENT):
        entry = datasets.get(dataset, {})
        if not isinstance(entry, dict):
            raise ValueError(f"the profile of {dataset} must be an object")
        if not isinstance(entry.get("custom_column_map") or {}, dict):
            raise ValueError(f"custom_column_map of {dataset} must be an object")
    return profile


def profile_column_map(profile: Mapping | None, dataset: str) -> dict[str, str]:
    """Source header -> canonical name, empty when the profile says nothing about the dataset."""
    node: object = profile
    for key in ("dataset_profiles", dataset, "custom_column_map"):
        node = node.get(key) if isinstance(node, Mapping) else None
    if not isinstance(node, Mapping):
        return {}
    return {str(source): str(target) for source, target in node.items()}
