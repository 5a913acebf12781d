import pytest

from tessera import config
from tessera.operators.validate import ConfigError
from tessera.sources import experiments


def test_presets_ranges_and_files(tmp_path):
    small = config.preset(config.MODELS, "small")
    assert small.hidden_dim == 256 and config.preset(config.MODELS, "experimental").approx_params() == 4096 * 128 + 4 * (4 * 128 * 128 + 2 * 128 * 512 + 4 * 128)
    with pytest.raises(KeyError):
        config.preset(config.TRAINING, "huge")
    small.save(str(tmp_path / "m.json"))
    assert config.ModelConfig.load(str(tmp_path / "m.json")) == small
    assert config.TrainingConfig.from_dict({"batch_size": 2, "other": 1}).batch_size == 2
    for bad in (lambda: config.ModelConfig(vocab_size=0), lambda: config.ModelConfig(n_heads=3), lambda: config.TrainingConfig(schedule="x"), lambda: config.GenerationConfig(top_p=0.0)):
        with pytest.raises(ConfigError):
            bad()


def test_experiment_records(spark, tmp_path):
    run = experiments.Experiment(str(tmp_path), "a", {"lr": 0.1})
    run.log(1, 2.0)
    run.log(2, 1.5, 1.7)
    run.finish()
    experiments.Experiment.load(run.path).log(3, 1.0, 1.9)
    rows = experiments.read(spark, str(tmp_path))
    assert rows.first()["best_val_loss"] == 1.7 and rows.first()["status"] == "finished"
    assert experiments.metrics(rows).count() == 3
