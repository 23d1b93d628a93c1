"""Multi-operator plans: rendered insights, prompts, the demo mapping and its queries."""
