"""riskweave: rule-based text-risk analytics and corpus preparation as Spark DataFrame plans."""
