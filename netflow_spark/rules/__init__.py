"""Rule language: YAML rule packs compiled to Spark Column expressions."""

from .compile import (RuleFileError, RulePack, compile_condition, compile_rule, default_rules,
                      default_rules_path, load_rules, rule_mask, tag)

__all__ = ["RuleFileError", "RulePack", "compile_condition", "compile_rule", "default_rules",
           "default_rules_path", "load_rules", "rule_mask", "tag"]
