"""Company turnover analytics on Spark: cleaning, panels, features, model
selection, recursive forecasts and growth reports as DataFrame operators."""
